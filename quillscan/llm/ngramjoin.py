"""Jaccard join of word n-gram sets by prefix trees.

A document's set holds its distinct word n-grams, as 64-bit values in one global order:
n-grams of rare words first, n-grams that many documents share last. Order statistics are
counts of words and n-grams in buckets, over all documents. Documents of equal sets are one
class from the start. Two sets above the threshold have near sizes and share several n-grams
among the first of each (the prefix). For every n-gram that lies in the prefix of two classes
or more of one band of sizes, the smallest class key among them names a group; n-grams of the
same near copies name the same key, which keeps a class to few groups. A class with too few
n-grams in groups has no partner, and groups that hold too few of its n-grams to be its only
meeting place with a partner are given up.

In a group the sets are stored in a trie. A query walks down it; sets with a common
beginning share the partial overlap counted so far, and a subtree is left as soon as the
overlap, with all that remains of the query and of the longest set below, can't reach the
threshold, or when all sets below are in the query's component already. Walks go on for many
queries at once, in numpy. A group of more than ``GROUP`` n-grams is cut into blocks, and
each pair of blocks is solved on its own. Tasks return spanning forests of links, which are
joined into components.

Sent to every task: bucket classes (1.3 MB) and a bitmap of classes in groups (8 MB), both of
fixed size; more classes than the bitmap tells apart only send more sets, never fewer.
Classes are told apart by 128-bit digests of their whole sets, n-grams in a join by 64 bits.

Defined results: a null text counts as empty; a document without words has an empty set and
links with nothing, so its component is itself; equal sets that aren't empty always link; a
null id takes part but names a component only if all its ids are null; repeated rows keep a
row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, join_named, tasks
from .simhash import _merge, components

SEED = np.uint64(42)
WORD_BUCKETS, GRAM_BUCKETS, SLICE = 1 << 18, 1 << 20, 1 << 12
#: Word forms whose hash a task keeps at a time.
FORMS = 1 << 20
#: N-grams of a block; a group of more is cut.
GROUP = 1 << 20
#: Bits of the bitmap of classes that are in a group.
BITMAP = 1 << 26
#: N-grams of a trie edge that a step compares, and walks in one step.
EDGE, STEP = 32, 1 << 15
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Hash of a word, looked up or made."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= FORMS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every n-gram of ``size`` words; of the whole sequence where it has fewer."""
    n = min(size, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        h = (h ^ (h >> np.uint64(31))) * _M1 + words[i:len(words) - n + 1 + i]
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(29))


def digest(hashes: np.ndarray) -> bytes:
    """128-bit digest of a sorted set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _statistics(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, dict]:
    """The rows (doc_id, sig, n), frozen, and the classes of word and n-gram buckets."""

    def scan(batches):
        known, counts = WordHashes(), [np.zeros(WORD_BUCKETS, np.uint32), np.zeros(GRAM_BUCKETS, np.uint32)]
        schema = pa.schema([("doc_id", pa.int64()), ("sig", pa.binary()), ("n", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])

        def add(found):
            for total, parts in zip(counts, found):
                total += np.bincount(np.concatenate(parts), minlength=len(total)).astype(np.uint32)

        for batch in batches:
            sigs, sizes, found, held = [], [], ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]), 0
            for text in batch.column(1).to_pylist():
                words = word_hashes(text, known)
                grams = np.unique(gram_hashes(words, size))
                sigs.append(digest(grams) if len(grams) else None)
                sizes.append(len(grams))
                found[0].append((words & np.uint64(WORD_BUCKETS - 1)).astype(np.int64))
                found[1].append((grams & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64))
                held += len(words)
                if held > 1 << 20:
                    add(found)
                    found, held = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]), 0
            add(found)
            none = pa.nulls(len(sigs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()),
                                              none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        flat = np.concatenate(counts)
        parts = [i for i in range(0, len(flat), SLICE) if flat[i:i + SLICE].any()]
        none = pa.nulls(len(parts))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()),
                                          pa.array([i // SLICE for i in parts], pa.int32()),
                                          pa.array([flat[i:i + SLICE].tobytes() for i in parts], pa.binary())], schema=schema)

    both = frozen(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
                  .mapInArrow(scan, "doc_id long, sig binary, n long, part int, counts binary"), "ngram-sets")

    def add_up(pdf):
        total = np.zeros(SLICE, np.uint64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint32 if len(c) == 4 * SLICE else np.uint64)
        return pd.DataFrame({"part": pdf["part"][:1], "counts": [total.tobytes()]})

    parts = both.where("part IS NOT NULL").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("salt"))
    parts = parts.groupBy("part", "salt").applyInPandas(add_up, "part int, counts binary")
    parts = parts.groupBy("part").applyInPandas(add_up, "part int, counts binary").collect()  # a row for each slice of buckets
    flat = np.zeros(WORD_BUCKETS + GRAM_BUCKETS, np.float64)
    for r in parts:
        flat[r.part * SLICE:(r.part + 1) * SLICE] = np.frombuffer(r.counts, np.uint64)
    words, grams = flat[:WORD_BUCKETS], flat[WORD_BUCKETS:]
    # rarity of a word in bits, 18 at most; above four times the mean an n-gram counts as frequent, by its logarithm
    rare = np.clip(np.round(np.log2(max(words.sum(), 1) / np.maximum(words, 1))), 0, 18).astype(np.uint8)
    often = np.maximum(grams, 1) / max(grams.mean(), 64)
    often = np.where(often > 4, np.clip(np.log2(often) - 1, 1, 7), 0).astype(np.uint8)
    return both.where("part IS NULL").select("doc_id", "sig", "n"), {"rare": rare, "often": often}


def ordered_set(words: np.ndarray, size: int, order: dict) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, the set in global order) of a document; both have one value for an n-gram."""
    grams = gram_hashes(words, size)
    hashes, first = np.unique(grams, return_index=True)
    bits = order["rare"][(words & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)].astype(np.int64)
    n = len(words) - len(grams) + 1
    rarity = sum(bits[i:len(grams) + i] for i in range(n))[first]
    often = order["often"][(hashes & np.uint64(GRAM_BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
    rank = np.where(often > 0, np.uint64(56) + often, (54 - rarity * 54 // (18 * n)).astype(np.uint64))
    return hashes, np.sort((rank << np.uint64(58)) | (hashes >> np.uint64(6)))


def _can_miss(n: int, num: int, den: int) -> int:
    """N-grams of a set of ``n`` that a set above ``num/den`` may lack; -1 if only equal sets can be that near."""
    return -1 if n * den < (n + 1) * num else n + n * -num // den


def shared_first(n: int, num: int, den: int) -> int:
    """How many shared n-grams the prefix of a set of ``n`` is long enough for."""
    return _can_miss(n, num, den) // 2 + 1


def prefix_length(n: int, num: int, den: int) -> int:
    """First n-grams of a set of ``n`` that hold ``shared_first`` of those it shares with any set above ``num/den``."""
    miss = _can_miss(n, num, den)
    return 0 if miss < 0 else miss + shared_first(n, num, den)


def size_bands(n: int, num: int, den: int) -> range:
    """Bands of set sizes (each half as wide again) in which a set of ``n`` can meet a set of its size or more."""
    bounds = [den]
    while bounds[-1] <= n * den // num:
        bounds.append(bounds[-1] * 3 // 2 + 1)
    return range(bisect.bisect_right(bounds, n), bisect.bisect_right(bounds, n * den // num) + 1)


def _lcp(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    apart = np.flatnonzero(a[:m] != b[:m])
    return int(apart[0]) if len(apart) else m


class Trie:
    """Sets of several groups, compressed: a node is an edge of n-grams above the sorted sets from lo to hi."""

    def __init__(self, groups: list[int], sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: (groups[i], sets[i].astype(">u8").tobytes()))
        rows = [sets[i] for i in self.order]
        names = [groups[i] for i in self.order]
        self.size = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.grams = np.concatenate(rows)
        shared = np.array([0] + [_lcp(rows[i - 1], rows[i]) if names[i - 1] == names[i] else -1 for i in range(1, len(rows))], np.int64)
        lo, hi, start, end, child, children = [], [], [], [], [], []
        cuts = [0] + [i for i in range(1, len(rows)) if shared[i] < 0] + [len(rows)]
        todo = [(a, b, 0) for a, b in zip(cuts, cuts[1:])]
        self.root = {names[a]: i for i, (a, _, _) in enumerate(todo)}
        done = 0
        while done < len(todo):
            a, b, depth = todo[done]
            done += 1
            if b - a == 1:
                stop, below = int(self.size[a]), []
            else:
                inner = shared[a + 1:b]
                stop = int(inner.min())
                below = (np.flatnonzero(inner == stop) + a + 1).tolist()
                if self.size[a] > stop:
                    below = [a] + below
            lo.append(a), hi.append(b), start.append(depth), end.append(stop)
            child.append(len(todo)), children.append(len(below))
            todo += [(x, y, stop) for x, y in zip(below, below[1:] + [b])]
        self.lo, self.hi, self.start, self.end, self.child, self.children = (np.array(x, np.int64) for x in (lo, hi, start, end, child, children))
        self.least = np.array([self.size[a:b].min() for a, b in zip(lo, hi)], np.int64)
        self.most = np.array([self.size[a:b].max() for a, b in zip(lo, hi)], np.int64)


def forest(groups: list[int], sets: list[np.ndarray], home: list[bool], query: list[bool], num: int, den: int) -> np.ndarray:
    """Labels of the sets: equal for those joined by links between a home and a query of one group.

    In a group either every set is home and query, or each is one of them.
    """
    labels = np.arange(len(sets))
    homes = [i for i in range(len(sets)) if home[i]]
    asks = [i for i in range(len(sets)) if query[i]]
    if not homes or not asks:
        return labels
    trie = Trie([groups[i] for i in homes], [sets[i] for i in homes])
    member = np.array([homes[i] for i in trie.order])  # sorted place -> number of the set
    place = np.full(len(sets), -1)
    place[member] = np.arange(len(member))
    # queries of a group one after the other, the first of every group first: what they link is left out later
    seen: dict = {}
    ranked = []
    for i in asks:
        if groups[i] in trie.root:
            seen[groups[i]] = seen.get(groups[i], -1) + 1
            ranked.append((seen[groups[i]], i))
    asks = [i for _, i in sorted(ranked)]
    if not asks:
        return labels
    vocabulary, flat = np.unique(np.concatenate([trie.grams] + [sets[i] for i in asks]), return_inverse=True)
    n_vocabulary = len(vocabulary)
    ids = flat[:len(trie.grams)].astype(np.int64)
    sizes = np.array([len(sets[i]) for i in asks], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    keys = flat[len(trie.grams):].astype(np.int64) + np.repeat(np.arange(len(asks)), sizes) * n_vocabulary
    asks = np.array(asks)
    total = num + den  # overlap * total >= num * (sizes) is overlap / union >= num / den
    stack, step = [], 1
    at = 0
    pieces = []
    while at < len(asks):
        pieces.append(np.arange(at, min(at + step, len(asks))))
        at, step = at + step, min(2 * step, STEP)
    for who in reversed(pieces):
        node = np.array([trie.root[groups[i]] for i in asks[who]])
        stack.append((who, node, np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)))
    while stack:
        who, node, depth, overlap = stack.pop()
        # sets below that come before the query, or are all in its component, are left out
        mixed = np.concatenate([[0], np.cumsum(labels[member][1:] != labels[member][:-1])])
        lo, hi, mine = trie.lo[node], trie.hi[node], place[asks[who]]
        one = mixed[lo] == mixed[hi - 1]
        go = (hi - 1 > mine) & ~(one & (labels[member[lo]] == labels[asks[who]]))
        who, node, depth, overlap = who[go], node[go], depth[go], overlap[go]
        if not len(who):
            continue
        if len(who) > STEP:
            stack.append((who[STEP:], node[STEP:], depth[STEP:], overlap[STEP:]))
            who, node, depth, overlap = who[:STEP], node[:STEP], depth[:STEP], overlap[:STEP]
        length = np.minimum(trie.end[node] - depth, EDGE)
        some = length > 0
        rest = sizes[who]  # of the query, after the edge's last n-gram; the walk has passed what comes before
        after = np.zeros(len(who), np.int64)
        if some.any():
            ends = np.cumsum(length)
            offset = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
            gram = ids[np.repeat(trie.at[trie.lo[node]] + depth, length) + offset]
            probe = np.repeat(who, length) * n_vocabulary + gram
            found = np.searchsorted(keys, probe)
            hit = keys[np.minimum(found, len(keys) - 1)] == probe
            sums = np.concatenate([[0], np.cumsum(hit)])
            overlap = overlap + sums[ends] - sums[ends - length]
            last = ends[some] - 1
            after[some] = found[last] + hit[last] - starts[who[some]]
            depth = depth + length
        # an empty edge only hands on to its children, which bring the bound
        rest = np.where(some, rest - after, rest)
        low, high = trie.least[node], trie.most[node]
        best = np.clip(depth + rest, low, high)
        fit = (overlap + np.minimum(best - depth, rest)) * total >= num * (sizes[who] + best)
        who, node, depth, overlap = who[fit], node[fit], depth[fit], overlap[fit]
        whole = depth == trie.end[node]
        ended = whole & (trie.size[trie.lo[node]] == depth) & (trie.lo[node] > place[asks[who]])
        if ended.any():
            q, s = who[ended], trie.lo[node[ended]]
            near = overlap[ended] * total >= num * (sizes[q] + trie.size[s])
            _merge(labels, asks[q[near]], member[s[near]])
        more = ~whole
        kids = trie.children[node] * whole
        if kids.any():
            ends = np.cumsum(kids)
            below = np.repeat(trie.child[node], kids) + np.arange(int(ends[-1])) - np.repeat(ends - kids, kids)
            stack.append((np.repeat(who, kids), below, np.repeat(depth, kids), np.repeat(overlap, kids)))
        if more.any():
            stack.append((who[more], node[more], depth[more], overlap[more]))
    return labels


def _solve(num: int, den: int):
    """Rows of (grp, h, q, side, sig, codes), sorted by group, to the links (u, v) of a spanning forest of each batch."""
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])

    def links(rows):
        groups, sets, home, query, sigs, number, seen = [], [], [], [], [], {}, set()
        for key, side, sig, codes in rows:
            if (key, sig) in seen:  # copies found by several tasks
                continue
            seen.add((key, sig))
            groups.append(number.setdefault(key, len(number)))
            sets.append(np.frombuffer(codes, np.uint64))
            home.append(side != 2)
            query.append(side != 1)
            sigs.append(sig)
        labels = forest(groups, sets, home, query, num, den)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array([sigs[i] for i in moved], pa.binary()),
                                           pa.array([sigs[labels[i]] for i in moved], pa.binary())], schema=schema)

    def solve(batches):
        held, n = [], 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for g, h, q, side, sig, codes in zip(*cols):
                if n >= GROUP and held[-1][0] != (g, h, q):
                    yield links(held)
                    held, n = [], 0
                held.append(((g, h, q), side, sig, codes))
                n += len(codes) // 8
        if held:
            yield links(held)

    return solve


def links(docs: DataFrame, order: dict, text_col: str = "text", size: int = 3, num: int = 9, den: int = 10,
          group: int = GROUP) -> DataFrame:
    """Spanning forest (u, v) of the links between the documents' distinct sets, named by their digests."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")

    def distinct(batches):
        """(digest, key, set) of each set that is new to the task."""
        known, seen = WordHashes(), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = word_hashes(text, known)
                if len(words):
                    hashes, codes = ordered_set(words, size, order)
                    sig = digest(hashes)
                    if sig not in seen and prefix_length(len(codes), num, den):
                        seen.add(sig)
                        yield sig, int.from_bytes(sig[:8], "little", signed=True), codes

    def prefixes(batches):
        schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("least", pa.int32())])

        def out(held):
            sizes = [len(p) for *_, p in held]
            columns = [np.repeat(np.array([h[i] for h in held]), sizes) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p for *_, p in held]).view(np.int64)), pa.array(columns[0], pa.int64()),
                                               pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], schema=schema)

        held, total = [], 0
        for _, key, codes in distinct(batches):
            n = len(codes)
            first = codes[:prefix_length(n, num, den)]
            least = shared_first(-(-n * num // den), num, den)  # that its smallest partner's prefix shares with it
            # the n-gram's value is mixed with the band of sizes
            held += [(key, n, max(least, 1), first + np.uint64(band * int(_M2) & (1 << 64) - 1)) for band in size_bands(n, num, den)]
            total += len(held[-1][3])
            if total >= 1 << 17:
                yield out(held)
                held, total = [], 0
        if held:
            yield out(held)

    postings = frozen(texts.mapInArrow(prefixes, "gram long, key long, n int, least int"), "ngram-prefixes")
    hubs = (postings.groupBy("gram").agg(F.min("key").alias("hub"), F.max("key").alias("other"))
            .where("hub < other").select("gram", "hub"))
    counted = postings.join(hubs, "gram").groupBy("key", "hub", "n", "least").agg(F.count("*").alias("grams"))
    # two near sets share ``least`` n-grams here: a set with fewer in groups has no partner, and if either set
    # gives up groups with less than half of that, a group remains in which they meet
    own = Window.partitionBy("key")
    running = F.sum("grams").over(own.orderBy("grams", "hub").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.select("key", "hub", "n", "least", running.alias("running"), F.sum("grams").over(own).alias("total"))
    members = frozen(counted.where("total >= least AND running > (least - 1) div 2").select("key", "hub", "n"), "ngram-members")
    sizes = members.groupBy("hub").agg(F.ceil(F.sum("n") / group).alias("blocks"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    members = members.join(sizes, "hub")

    # a bitmap of the classes in groups: only their sets travel
    slots = (members.selectExpr(f"shiftright(pmod(key, {BITMAP}L), 5) AS slot", "shiftleft(1L, int(pmod(key, 32L))) AS bit")
             .groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect())  # BITMAP / 32 rows at most
    bitmap = np.zeros(BITMAP // 32, np.uint32)
    if slots:
        bitmap[[r.slot for r in slots]] = [r.bits for r in slots]

    def wanted(batches):
        schema = pa.schema([("key", pa.int64()), ("sig", pa.binary()), ("codes", pa.binary())])

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in held], pa.int64()), pa.array([s for _, s, _ in held], pa.binary()),
                                               pa.array([c for _, _, c in held], pa.binary())], schema=schema)

        held, total = [], 0
        for sig, key, codes in distinct(batches):
            b = key % BITMAP
            if bitmap[b >> 5] >> (b & 31) & 1:
                held.append((key, sig, codes.tobytes()))
                total += len(codes)
                if total >= 1 << 19:
                    yield out(held)
                    held, total = [], 0
        if held:
            yield out(held)

    sets = texts.mapInArrow(wanted, "key long, sig binary, codes binary")
    dealt = members.select("key", "hub", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("own"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", "hub", F.least("own", "other").alias("h"), F.greatest("own", "other").alias("q"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    rows = sets.join(pairs, "key").select("hub", "h", "q", "side", "sig", "codes")
    return (rows.repartition(tasks(spark), "hub", "h", "q").sortWithinPartitions("hub", "h", "q")
            .mapInArrow(_solve(num, den), "u binary, v binary"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 9, den: int = 10,
           group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link at ``num/den`` of similarity or more."""
    rows, order = _statistics(docs, id_col, text_col, size)
    classes = frozen(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "ngram-classes")
    roots = components(links(docs, order, text_col, size, num, den, group))
    named = classes.join(roots, classes.sig == roots.node, "left").select("sig", F.coalesce("root", "sig").alias("root"), "least_id", "copies")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = frozen(named.select("sig", "root", "copies").join(least, "root").select("sig", "copies", "component_id"), "ngram-named")
    linked = join_named(rows.where("n > 0"), named, "sig", "copies")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
