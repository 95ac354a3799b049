"""SimHash near-duplicate groups by vantage-point trees over 64-bit fingerprints.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles.
Distinct fingerprints are dealt to shards by a vantage-point tree: each node keeps a
vantage fingerprint and a radius, fingerprints within the radius go inside, the others
outside. A fingerprint lives in one home shard and also visits every shard whose region
its search ball overlaps (triangle bound), so all pairs within ``max_bits`` meet. Inside
a shard the same tree goes on, vectorised, down to small leaves. A shard returns a
spanning forest of its links, not its pairs; the forests are joined into components by
alternating large-star and small-star steps.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and
links like any other; a null ``doc_id`` takes part but never names a component unless
all ids of that component are null (then the name is null); repeated rows keep one
result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen, row_key, tasks

SEED = 42
#: Fingerprints sampled to choose vantage points; it affects balance only, not results.
SAMPLE = 2048
#: Fingerprints at home in a shard, about.
SHARD = 65536
#: A shard with more members than this (4 MB of fingerprints) is solved in blocks of so many.
SHARD_BLOCK = 1 << 19
LEAF = 256
PAIRS_AT_ONCE = 1 << 22


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED)
                  for i, j in zip(starts[:1 - shingle or None].tolist(), ends[shingle - 1:].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = 3) -> DataFrame:
    """(doc_id, row_key, fp) of every row; fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"),
                       fp(F.col(f"`{text_col}`")).alias("fp"))


def _distance(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v).astype(np.int16)


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that halve ``points`` with the fewest on the boundary."""
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = _distance(points, v)
        mu = int(np.median(d))
        inside = int((d <= mu).sum())
        if inside == len(points):
            mu, inside = mu - 1, int((d <= mu - 1).sum())
        if 0 < inside < len(points):
            cost = max(inside, len(points) - inside) + int((abs(d - mu) <= 2).sum())
            if best is None or cost < best[0]:
                best = (cost, v, mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, radius, inside, outside); a child below 0 is shard ``-1 - child``."""
    nodes: list = []
    shards = 0

    def grow(points: np.ndarray, left: int) -> int:
        nonlocal shards
        cut = _split(points) if left and len(points) > 1 else None
        if cut is None:
            shards += 1
            return -shards
        v, mu = cut
        at = len(nodes)
        nodes.append(None)
        d = _distance(points, v)
        nodes[at] = (int(v), mu, grow(points[d <= mu], left - 1), grow(points[d > mu], left - 1))
        return at

    grow(sample, depth)
    return nodes


def _deal(fps: np.ndarray, nodes: list, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions in fps, whether each is at home there)."""
    stack = [(0 if nodes else -1, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        at, who, home = stack.pop()
        if not len(who):
            continue
        if at < 0:
            yield -1 - at, who, home
            continue
        v, mu, inside, outside = nodes[at]
        d = _distance(fps[who], np.uint64(v))
        near, far = d <= mu + bits, d > mu - bits
        stack.append((inside, who[near], (home & (d <= mu))[near]))
        stack.append((outside, who[far], (home & (d > mu))[far]))


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; a label is the smallest position of its set."""
    while True:
        a, b = labels[a], labels[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _link(points: np.ndarray, home: np.ndarray, query: np.ndarray, bits: int, labels: np.ndarray) -> None:
    """Unite every query with every home point within ``bits``, by a vantage-point search."""
    stack = [(home, query)]
    while stack:
        h, q = stack.pop()
        if not len(h) or not len(q):
            continue
        cut = None
        if len(h) > LEAF:
            cut = _split(points[h])
        if cut is None:
            step = max(1, PAIRS_AT_ONCE // len(h))
            for i in range(0, len(q), step):
                part = q[i:i + step]
                near = np.bitwise_count(points[part][:, None] ^ points[h][None, :]) <= bits
                near &= labels[part][:, None] != labels[h][None, :]
                a, b = np.nonzero(near)
                if len(a):
                    _merge(labels, part[a], h[b])
            continue
        v, mu = cut
        dh, dq = _distance(points[h], v), _distance(points[q], v)
        stack.append((h[dh <= mu], q[dq <= mu + bits]))
        stack.append((h[dh > mu], q[dq > mu - bits]))


def _forest(home: np.ndarray, query: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.unique(np.concatenate([home, query]))
    labels = np.arange(len(points))
    _link(points, np.searchsorted(points, home), np.searchsorted(points, query), bits, labels)
    linked = labels != np.arange(len(points))
    return points[linked], points[labels[linked]]


def links(reps: DataFrame, max_bits: int = 2, shard: int = SHARD, block: int = SHARD_BLOCK) -> DataFrame:
    """Spanning forest (u, v) of the links between the distinct ``fp`` of ``reps``."""
    spark = reps.sparkSession
    n = reps.count()
    sample = np.array([r.fp for r in reps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()],
                      np.int64).view(np.uint64)
    nodes = build_tree(sample, max(0, int(np.ceil(np.log2(max(1, n / shard))))))

    def deal(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy().view(np.uint64)
            for at, who, home in _deal(fps, nodes, max_bits):
                yield pd.DataFrame({"shard": at, "fp": fps[who].view(np.int64), "home": home})

    dealt = frozen(reps.select("fp").mapInPandas(deal, "shard int, fp long, home boolean"), "simhash-shards")
    # a shard of many fingerprints is solved in blocks: each home block meets each query block
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    sided = dealt.join(sizes, "shard")
    as_home = (sided.where("home").withColumn("h", own).withColumn("q", F.explode(blocks))
               .select("shard", "h", "q", "fp", F.lit(True).alias("home")))
    as_query = (sided.withColumn("q", own).withColumn("h", F.explode(blocks))
                .select("shard", "h", "q", "fp", F.lit(False).alias("home")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy().view(np.uint64)
        home = pdf["home"].to_numpy()
        u, v = _forest(fps[home], fps[~home], max_bits)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return (as_home.unionByName(as_query).repartition(tasks(spark), "shard", "h", "q")
            .groupBy("shard", "h", "q").applyInPandas(solve, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); root is the component's smallest node."""
    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = frozen(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
               "components")
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
                 .select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v"))
        e = frozen(small.distinct(), "components")
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
           max_bits: int = 2) -> DataFrame:
    """(doc_id, row_key, fp, component, component_id) of every row of ``docs``.

    ``component`` is the smallest fingerprint of the row's component, ``component_id``
    the smallest doc_id in it.
    """
    fps = frozen(with_fingerprint(docs, id_col, text_col, shingle), "simhash")
    reps = frozen(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-reps")
    roots = components(links(reps, max_bits))
    named = reps.join(roots, reps.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("component"), "least_id")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.select("fp", "component").join(least, "component")
    return fps.join(named, "fp").select("doc_id", "row_key", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest non-null doc_id.

    Rows equal in id and text count as one. A component whose ids are all null keeps the
    row with the smallest content key.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    chosen = (groups(docs, id_col, text_col, shingle, max_bits).groupBy("component")
              .agg(F.min_by("row_key", order).alias("__row_key")).select("__row_key"))
    return (docs.withColumn("__row_key", row_key(id_col, text_col)).join(chosen, "__row_key", "left_semi")
            .dropDuplicates(["__row_key"]).select(*[F.col(f"`{c}`") for c in docs.columns]))
