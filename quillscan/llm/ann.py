"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are dealt to shards by a hash of their id. A shard projects its vectors on
``PROJECTIONS`` random lines and sorts each projection. A query takes, on every line, the
window of values within ``radius`` of its own; a vector collides on a line when its value
is in the window. The radius grows by ``GROWTH`` (virtual rehashing: the windows widen,
nothing is hashed anew) and only the new ends of each window are counted. A vector that
reaches the collision threshold is verified by its true distance. A query stops when
``k`` verified vectors lie within the radius.

The threshold is set so that a vector within the radius reaches it with a chance of at
least 97 %: the number of collisions of a vector at distance d is binomial with
P(|N(0, 1)| <= radius / d). As every one of the true nearest lies within the radius when
a query stops, that is also the expected recall. There is no cap on verified vectors.
Every query meets every shard, in blocks; a shard returns its k nearest, and these are
merged.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows with a null id; vectors of different lengths are
never compared; a repeated id counts once, with its smallest distance; ties go to the
smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks

PROJECTIONS = 64
GROWTH = 1.15
MISS = 0.03
#: Rows of a shard and queries of a block, about.
SHARD, QUERY_BLOCK = 32768, 4096
SEED = 12345


def threshold(projections: int = PROJECTIONS, miss: float = MISS) -> int:
    """Collisions that a vector at distance = radius reaches with chance 1 - miss."""
    n = NormalDist()
    p = 2 * n.cdf(1.0) - 1
    return max(1, int(projections * p + n.inv_cdf(miss) * (projections * p * (1 - p)) ** 0.5))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Index:
    """The sorted projections of one shard."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.points = ids, points
        lines = np.random.Generator(np.random.PCG64(SEED)).standard_normal((points.shape[1], projections))
        self.lines = lines
        values = points @ lines
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32).copy()
        self.values = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        with np.errstate(over="ignore", invalid="ignore"):
            spread = float(np.median(values.std(axis=0))) if len(values) else 0.0
        self.first_radius = spread / 4 if 0 < spread < np.inf else 1.0
        self.need = threshold(projections)

    def nearest(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest found, nearest first, ties to smaller ids."""
        n, m = len(self.ids), len(self.values)
        at = query @ self.lines
        count = np.zeros(n, np.int16)
        distance, seen = np.full(n, np.inf), np.zeros(n, bool)
        low = np.array([np.searchsorted(v, x) for v, x in zip(self.values, at)])
        high = low.copy()
        others = int((self.ids != own).sum())
        found = np.zeros(0, np.int64)
        radius = self.first_radius
        while True:
            gap = np.inf  # from the query to the next value outside any window
            for j in range(m):
                v = self.values[j]
                a = np.searchsorted(v, at[j] - radius, "left")
                b = np.searchsorted(v, at[j] + radius, "right")
                if a < low[j]:
                    count[self.order[j, a:low[j]]] += 1
                    low[j] = a
                if b > high[j]:
                    count[self.order[j, high[j]:b]] += 1
                    high[j] = b
                if low[j]:
                    gap = min(gap, at[j] - v[low[j] - 1])
                if high[j] < n:
                    gap = min(gap, v[high[j]] - at[j])
            new = np.nonzero((count >= self.need) & ~seen)[0]
            if len(new):
                seen[new] = True
                with np.errstate(over="ignore"):
                    distance[new] = np.sqrt(((self.points[new] - query) ** 2).sum(axis=1))
                found = np.concatenate([found, new[self.ids[new] != own]])
            if len(found) >= others or gap == np.inf or (distance[found] <= radius).sum() >= k:
                break
            radius = max(radius * GROWTH, gap)  # smaller windows would hold nothing more
        best = found[np.lexsort((self.ids[found], distance[found]))[:k]]
        return best, distance[best]


def _solve(queries: tuple, data: tuple, k: int) -> pd.DataFrame:
    (query_ids, query_points), (ids, points) = queries, data
    out = []
    if len(ids) and len(query_ids):
        order = np.argsort(ids, kind="stable")
        index = Index(ids[order], points[order])
        repeated = len(np.unique(ids)) < len(ids)
        for q, x in zip(query_ids.tolist(), query_points):
            # ids that repeat may fill more than k places: take all places up to the k-th id
            best, distance = index.nearest(x, q, k if not repeated else len(ids))
            if repeated:
                _, first = np.unique(index.ids[best], return_index=True)
                first = np.sort(first)[:k]
                best, distance = best[first], distance[first]
            out.append(pd.DataFrame({"query_id": q, "vec_id": index.ids[best], "score": distance}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found by Euclidean distance.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows but the query's own.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("nq")).where("nq > 0")
    sizes = sizes.select("dim", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("nq") / query_block).cast("int").alias("blocks"))
    rows = rows.join(sizes, "dim")  # a row for each length of vector: small
    own, block = F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = rows.withColumn("shard", own).withColumn("block", every("blocks")).withColumn("query", F.lit(False))
    queries = rows.where(is_query).withColumn("block", block).withColumn("shard", every("shards")).withColumn("query", F.lit(True))
    columns = ["dim", "shard", "block", "query", "vec_id", "v"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q, ids = pdf["query"].to_numpy(), pdf["vec_id"].to_numpy()
        points = np.stack(pdf["v"].to_numpy())
        return _solve((ids[is_q], points[is_q]), (ids[~is_q], points[~is_q]), k)

    near = (data.select(columns).unionByName(queries.select(columns)).repartition(tasks(spark), "dim", "shard", "block")
            .groupBy("dim", "shard", "block").applyInPandas(solve, "query_id long, vec_id long, score double"))
    near = near.distinct()  # a query row that repeats
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

