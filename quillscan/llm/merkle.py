"""Merkle manifest of a table, and audit paths climbed by a recursive query.

Every row is a leaf. Leaves of one language form a tree of runs of eight; the roots of
these trees, in language order, form one more such tree. Each built level is stored as
node rows that carry the digests of a run's members and a link to the parent node (its
level, its number, the place in its run). A recursive query then starts at every leaf,
follows the links, appends a row with the siblings met on each level and folds the leaf's
hash, tampered for some rows, into the hashes above.

What bounds a task: runs have eight members, leaves are numbered by a range partitioning
with per-partition offsets (no group is sorted in one task), and a node above many leaves
is copied once for each ``CHUNK`` consecutive leaves below it, so that no join key meets
more than ``CHUNK`` leaves, the root's included. Copies add one row a level and chunk.

Defined results: a null column is hashed as ``-`` and a null language is a tree of its own,
the first; a null id comes before all others and is never tampered; rows with equal ids are
ordered by their leaf hash, equal rows are leaves of their own; a lone leaf is its tree's root,
and a lone tree's root is the root (its proof then is the hash of nothing where there are no
siblings at all); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import consecutive_index
from .common import frozen

ARITY = 8
#: Consecutive leaves that share one copy of every node above them.
CHUNK = 4096
#: Levels of the tree over the languages' roots are numbered from here on.
TOP = 100
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def _hex(digest) -> Column:
    return F.lower(F.hex(digest))


def leaf_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 (32 bytes) of the columns in order, each ``-`` or its byte count, ``:`` and value."""
    parts = []
    for c in columns.values():
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return _hash(F.concat(*parts))


def leaves(docs: DataFrame, columns=COLUMNS) -> DataFrame:
    """(number, doc_id, tree, digest, folded): every row in tree order, with its hash and the tampered one.

    ``tree`` sorts like the language, null first. ``folded`` is the hash with A-Z of the text
    lower-cased where 3 divides the CRC-32 of the decimal id, else the digest itself.
    """
    cols = {c: F.col(f"`{c}`") for c in columns}
    lowered = {**cols, "text": F.translate(cols["text"], UPPER, LOWER)}
    tampered = F.crc32(cols["doc_id"].cast("string").cast("binary")) % 3 == 0
    hashed = docs.select(
        cols["doc_id"].alias("doc_id"), F.coalesce(F.concat(F.lit("l"), cols["lang"]), F.lit("")).alias("tree"),
        leaf_hash(cols).alias("digest"), F.when(tampered, leaf_hash(lowered)).alias("folded"))
    hashed = frozen(hashed, "merkle-leaves")
    # equal rows get an order of their own (the record's place in the frozen table), which splits them over tasks
    placed = hashed.withColumn("place", F.monotonically_increasing_id())
    numbered = consecutive_index(placed, ["tree", "doc_id", "digest", "place"], out="number")
    return numbered.select("number", "doc_id", "tree", "digest", F.coalesce("folded", "digest").alias("folded"))


def _spread(first: Column, last: Column) -> Column:
    """The chunks of the leaves from number ``first`` to ``last``."""
    return F.sequence(F.floor(first / CHUNK), F.floor(last / CHUNK))


def _levels(members: DataFrame, base: int, name: str) -> list[DataFrame]:
    """Levels of runs above ``members`` (start, idx, n, digest), each frozen.

    ``start`` names the tree, ``idx`` is the place on its level of ``n`` nodes. A level's
    rows are (start, level, idx, n, children, digest).
    """
    out, level = [], base
    top = members.agg(F.max("n")).first()[0] or 1
    while top > 1:
        level += 1
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        rows = (members.where("n > 1").groupBy("start", F.floor(F.col("idx") / ARITY).alias("parent"), "n")
                .agg(F.aggregate(run, F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("children")))
        members = frozen(rows.select("start", F.lit(level).alias("level"), F.col("parent").alias("idx"),
                                     F.ceil(F.col("n") / ARITY).alias("n"), "children",
                                     _hash(_hex("children")).alias("digest")), f"merkle-{name}-{level}")
        out.append(members)
        top = -(-top // ARITY)
    return out


def _link(above: bool, level: Column) -> list[Column]:
    """Columns of the link to the parent: within the tree while it has more nodes, else to the top tree."""
    inside = F.col("n") > 1
    up = lambda a, b: F.when(inside, a).otherwise(b if above else F.lit(None)).cast("long")
    return [up(level + 1, F.lit(TOP + 1)).alias("p_level"),
            up(F.col("start") + F.floor(F.col("idx") / ARITY), F.floor(F.col("top_idx") / ARITY)).alias("p_node"),
            up(F.col("idx") % ARITY, F.col("top_idx") % ARITY).alias("p_pos")]


CLIMB = """
WITH RECURSIVE climb(leaf, chunk, level, p_level, p_node, p_pos, folded, siblings) AS (
    SELECT number, chunk, CAST(0 AS BIGINT), p_level, p_node, p_pos, folded, CAST('' AS BINARY) FROM {leaves}
    UNION ALL
    SELECT c.leaf, c.chunk, n.level, n.p_level, n.p_node, n.p_pos,
           unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.p_pos), c.folded,
                                       substring(n.children, 32 * c.p_pos + 33)))), 256)),
           concat(substring(n.children, 1, 32 * c.p_pos), substring(n.children, 32 * c.p_pos + 33))
    FROM climb c JOIN {nodes} n ON n.chunk = c.chunk AND n.level = c.p_level AND n.node = c.p_node)
SELECT leaf, level, CASE WHEN p_level IS NULL THEN folded END AS folded, siblings FROM climb LIMIT ALL"""


def audit(docs: DataFrame, columns=COLUMNS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``proof_sha256`` is the hash of the siblings' digests from the leaf's level up, left to
    right; ``folded_root`` the root recomputed from the tampered (else original) leaf.
    """
    spark = docs.sparkSession
    rows = frozen(leaves(docs, columns), "merkle-numbered")
    trees = rows.groupBy("tree").agg(F.min("number").alias("start"), F.count("*").alias("size"))
    trees = frozen(consecutive_index(trees, ["tree"], out="top_idx"), "merkle-trees")
    n_trees = trees.count()
    spans = trees.withColumn("chunk", F.explode(_spread(F.col("start"), F.col("start") + F.col("size") - 1)))
    chunk = F.floor(F.col("number") / CHUNK)
    placed = frozen(rows.withColumn("chunk", chunk).join(spans, ["chunk", "tree"])
                    .withColumn("idx", F.col("number") - F.col("start")).withColumn("n", F.col("size")), "merkle-placed")

    levels = _levels(placed.select("start", "idx", "n", "digest"), 0, "tree")
    inner = placed.select("start", F.lit(0).alias("level"), "idx", "n", F.lit(None).cast("binary").alias("children"), "digest")
    for level in levels:
        inner = inner.unionByName(level)
    subroots = inner.where("n = 1").select("start", F.col("digest").alias("subroot"))
    subroots = frozen(trees.join(subroots, "start"), "merkle-subroots")
    tops = _levels(subroots.select(F.lit(0).cast("long").alias("start"), F.col("top_idx").alias("idx"),
                                   F.lit(n_trees).cast("long").alias("n"), F.col("subroot").alias("digest")), TOP, "top")
    last = tops[-1].select("digest") if tops else subroots.select(F.col("subroot").alias("digest"))
    root = (last.first() or [None])[0]

    # node rows, copied for each chunk of the leaves below them
    width = F.pow(F.lit(ARITY), F.col("level")).cast("long")
    nodes = None
    for level in levels:
        below = level.join(subroots.select("start", "size", "top_idx"), "start")
        first = F.col("start") + F.col("idx") * width
        final = F.least(first + width, F.col("start") + F.col("size")) - 1
        copies = below.select(F.explode(_spread(first, final)).alias("chunk"), F.col("level").cast("long").alias("level"),
                              (F.col("start") + F.col("idx")).alias("node"), "children",
                              *_link(n_trees > 1, F.col("level")))
        nodes = copies if nodes is None else nodes.unionByName(copies)
    for k, level in enumerate(tops, 1):
        below = spans.select("chunk", F.floor(F.col("top_idx") / ARITY ** k).alias("idx")).distinct()
        level = level.select("idx", "n", "children", F.lit(0).alias("start"), F.lit(0).alias("top_idx"))
        copies = below.join(level, "idx").select("chunk", F.lit(TOP + k).cast("long").alias("level"), F.col("idx").alias("node"),
                                                 "children", *_link(False, F.lit(TOP + k)))
        nodes = copies if nodes is None else nodes.unionByName(copies)
    if nodes is None:  # a lone leaf, or none
        nodes = spark.createDataFrame([], "chunk long, level long, node long, children binary, p_level long, p_node long, p_pos long")
    nodes = frozen(nodes, "merkle-nodes")

    start = placed.select("number", "chunk", "folded", *_link(n_trees > 1, F.lit(0)))
    climbed = spark.sql(CLIMB, leaves=start, nodes=nodes)
    path = F.array_sort(F.collect_list(F.struct("level", "siblings")))
    proofs = climbed.groupBy("leaf").agg(
        F.sha2(_hex(F.aggregate(path, F.lit(b""), lambda a, x: F.concat(a, x["siblings"]))), 256).alias("proof_sha256"),
        _hex(F.max("folded")).alias("folded_root"))
    named = placed.join(subroots.join(spans.select("start", "chunk"), "start").select("start", "chunk", "subroot"), ["start", "chunk"])
    # a plain name for the leaf's number on each side keeps the join's key to one column
    out = named.join(proofs, F.col("number") == F.col("leaf"))
    root_hex = F.lit(root.hex() if root else None)
    return out.select("doc_id", _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), root_hex.alias("root"), "proof_sha256",
                      "folded_root", (F.col("folded_root") == root_hex).alias("verified"))
