"""Centroid clustering of integer vectors over blocks of a Hilbert curve with zone maps.

Vectors are ordered along a Hilbert curve through their components' value ranges and cut
into blocks; a block is one row that holds its vectors and, as its zone map, the least and
greatest value of each component. In every round a block's box bounds the distance of each
centroid from below and above: centroids whose lower bound exceeds the least upper bound
can't be nearest to any vector of the block, and the others are compared exactly, all
vectors at once. A round sends each task's centroids, sums and counts, never vectors.

Distances are exact: components up to 2**22 in size are compared by float64 products, which
hold these sums exactly, larger ones by Python integers. Sums travel in limbs of 30 bits.

What bounds memory: a block has ``BLOCK`` vectors; the driver holds the centroids, one sum
for each centroid and component, and a sample of keys for the range partitioning. Vectors
with equal curve keys are spread by a hash of their row, so a hot vector fills many tasks.

Defined results: a vector that is null, has another number of components than ``dims``, or
holds a null or non-finite component (or one that scaling makes so) takes no part and gives no row; a null id takes part
but becomes a first centroid only after all others; equal ids are told apart by their
components for the choice of first centroids; repeated rows are vectors of their own; with
fewer vectors than ``k`` each is a first centroid; an empty table gives an empty result;
distances and sums beyond a 64-bit integer are given as the largest one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen, tasks

BLOCK = 2048
#: Bits of each component in the curve's key.
CURVE_BITS = 2
#: Components up to this size have distances that float64 holds exactly (64 * (2 * 2**22)**2 <= 2**52).
EXACT = 1 << 22
LIMB = 30
MOST = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Position of each row of ``cells`` (integers below 2**bits) on the Hilbert curve, as bytes that sort like it."""
    x = cells.T.astype(np.uint32).copy()
    n = len(x)
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:  # undo the excess rotations, high bits first
        p = np.uint32(q - 1)
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(turned, p, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    flat = np.concatenate(planes).T.astype(np.uint8)
    return [row.tobytes() for row in np.packbits(flat, axis=1)]


def _exact(vectors: np.ndarray) -> np.ndarray:
    """Whole float64 values as integers: int64, or Python integers where these are too small."""
    if vectors.size == 0 or np.abs(vectors).max() < 2.0 ** 62:
        return vectors.astype(np.int64)
    return np.array([[int(v) for v in row] for row in vectors.tolist()], object)


def box_candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector between ``low`` and ``high``."""
    under, over = low[None, :] - centroids, centroids - high[None, :]
    outside = np.maximum(np.maximum(under, over), 0)
    reach = np.maximum(np.abs(under), np.abs(over))
    lower, upper = (outside * outside).sum(1), (reach * reach).sum(1)
    return np.nonzero(lower <= upper.min())[0]


def nearest(vectors: np.ndarray, centroids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(centroid number, squared distance) of every vector of a block; ties go to the smaller number."""
    largest = max(int(np.abs(vectors).max()), int(np.abs(centroids).max()))
    if largest <= EXACT:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        at = box_candidates(low.astype(np.float64), high.astype(np.float64), c)
        c = c[at]
        d = (v * v).sum(1)[:, None] - 2.0 * (v @ c.T) + (c * c).sum(1)[None, :]
    else:
        v, c = vectors.astype(object), centroids.astype(object)
        at = box_candidates(low.astype(object), high.astype(object), c)
        d = np.stack([((v - x) ** 2).sum(1) for x in c[at]], axis=1)
    best = d.argmin(1)
    return at[best], [int(x) for x in d[np.arange(len(d)), best]]


def _limbs(total: np.ndarray, n: int) -> list[int]:
    """``n`` limbs of each integer, the last one signed; all sums of limbs fit a long."""
    out = []
    for v in total.tolist():
        for _ in range(n - 1):
            out.append(v & ((1 << LIMB) - 1))
            v >>= LIMB
        out.append(v)
    return out


def blocks(docs: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vec_col: str = "embedding",
           block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The kept vectors in curve order, cut into blocks, and the same as rows (id, v, key), both frozen.

    A block is (ids, nulls, vectors, low, high, size): ``vectors`` are float64 bytes of whole
    numbers, ``low`` and ``high`` the box, ``nulls`` marks ids that are null.
    """
    spark = docs.sparkSession
    vec = F.col(f"`{vec_col}`")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) != float("inf")))
    # floor() gives a long; beyond its range a double is whole already
    whole = F.transform(vec, lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0 ** 60,
                                              F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    kept = docs.where((F.size(vec) == dims) & finite).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("v"))
    ends = kept.agg(*[f(F.get("v", F.lit(i))).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    low = np.array([ends[f"a{i}"] or 0.0 for i in range(dims)])
    high = np.array([ends[f"b{i}"] or 0.0 for i in range(dims)])
    step = np.maximum(high / 2 - low / 2, 0.5)

    def keyed(batches):
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, dims))
            cells = np.clip((v / 2 - low / 2) / step * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            yield pdf.assign(key=hilbert_keys(cells, CURVE_BITS))

    def cut(batches):
        ids, parts = [], []

        def row():
            i, v = np.concatenate(ids), np.concatenate(parts)
            for s in range(0, len(i), block):
                part, name = v[s:s + block], i[s:s + block]
                missing = np.isnan(name.astype(np.float64)) if name.dtype == object else np.zeros(len(name), bool)
                yield {"ids": [0 if m else int(n) for n, m in zip(name.tolist(), missing.tolist())], "nulls": missing.tolist(),
                       "vectors": part.tobytes(), "low": part.min(0).tobytes(), "high": part.max(0).tobytes(), "size": len(part)}

        held = 0
        for pdf in batches:
            if not len(pdf):
                continue
            ids.append(pdf["id"].to_numpy(object, na_value=float("nan")))
            parts.append(np.stack(pdf["v"].to_numpy()))
            held += len(pdf)
            if held >= block:  # whole blocks go, the rest waits
                rows = list(row())
                rest = rows.pop() if rows[-1]["size"] < block else None
                yield pd.DataFrame(rows)
                ids, parts, held = [], [], 0
                if rest:
                    ids = [np.array([float("nan") if m else n for n, m in zip(rest["ids"], rest["nulls"])], object)]
                    parts = [np.frombuffer(rest["vectors"]).reshape(-1, dims)]
                    held = rest["size"]
        if held:
            yield pd.DataFrame(list(row()))

    points = frozen(kept.mapInPandas(keyed, "id long, v array<double>, key binary"), "centroid-keys")
    # the hash splits the rows of one key over tasks
    spread = points.withColumn("h", F.xxhash64("id", "v", F.monotonically_increasing_id()))
    ranged = spread.repartitionByRange(tasks(spark), "key", "h").sortWithinPartitions("key", "h").select("id", "v")
    return frozen(ranged.mapInPandas(cut, "ids array<long>, nulls array<boolean>, vectors binary, low binary, high binary, size int"),
                  "centroid-blocks"), points


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of seed and id, as rows of integers."""
    order = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    rows = points.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([[int(x) for x in r.v] for r in rows], object)


def cluster(docs: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:",
            id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = docs.sparkSession
    table, points = blocks(docs, dims, scale, id_col, vec_col, block)
    centroids = first_centroids(points, k, seed)
    widest = max([int(abs(x)) for x in centroids.ravel()], default=0)
    reach = table.select(F.col("low"), F.col("high")).mapInPandas(
        lambda batches: (pd.DataFrame({"m": [float(max(np.abs(np.frombuffer(a)).max(), np.abs(np.frombuffer(b)).max()))
                                             for a, b in zip(pdf["low"], pdf["high"])]}) for pdf in batches), "m double")
    widest = max(widest, int(reach.agg(F.max("m")).first()[0] or 0))
    n_limbs = (widest.bit_length() + 32) // LIMB + 2

    def unpack(pdf, at):
        vectors = _exact(np.frombuffer(pdf["vectors"][at]).reshape(-1, dims))
        return vectors, _exact(np.frombuffer(pdf["low"][at]).reshape(1, -1))[0], _exact(np.frombuffer(pdf["high"][at]).reshape(1, -1))[0]

    for _ in range(rounds if len(centroids) else 0):
        now = centroids

        def assign(batches):
            sums, counts = {}, {}
            for pdf in batches:
                for at in range(len(pdf)):
                    vectors, low, high = unpack(pdf, at)
                    best, _ = nearest(vectors, now, low, high)
                    for c in np.unique(best).tolist():
                        mine = vectors[best == c]
                        sums[c] = sums.get(c, 0) + mine.sum(0).astype(object)
                        counts[c] = counts.get(c, 0) + len(mine)
            yield pd.DataFrame({"c": list(sums), "n": [counts[c] for c in sums], "limbs": [_limbs(sums[c], n_limbs) for c in sums]})

        parts = table.select("vectors", "low", "high").mapInPandas(assign, "c int, n long, limbs array<long>")
        # one row a centroid and component limb: the adding up is Spark's, map side first
        flat = parts.select("c", "n", F.posexplode("limbs").alias("at", "limb"))
        totals = flat.groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum("limb").alias("limb")).collect()
        sums, counts = {}, {}
        for r in totals:
            key = (r["c"], r["at"] // n_limbs)
            sums[key] = sums.get(key, 0) + (r["limb"] << (LIMB * (r["at"] % n_limbs)))
            counts[r["c"]] = r["n"]
        centroids = now.copy()
        for (c, i), total in sums.items():
            centroids[c, i] = total // counts[c]

    final = centroids

    def label(batches):
        for pdf in batches:
            for at in range(len(pdf)):
                vectors, low, high = unpack(pdf, at)
                best, distance = nearest(vectors, final, low, high)
                ids = pd.array([None if m else i for i, m in zip(pdf["ids"][at], pdf["nulls"][at])], "Int64")
                yield pd.DataFrame({"vec_id": ids, "cluster": best.astype(np.int32), "distance": [min(d, MOST) for d in distance]})

    rows = frozen(table.drop("size").mapInPandas(label, "vec_id long, cluster int, distance long"), "centroid-labels")
    wide = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    digests = [hashlib.sha256(",".join(str(x) for x in c).encode()).hexdigest() for c in final.tolist()]
    total = min(int(sum(r["s"] for r in wide)), MOST)
    named = spark.createDataFrame([(r["cluster"], min(int(r["s"]), MOST), total, digests[r["cluster"]]) for r in wide],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows are broadcast
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
