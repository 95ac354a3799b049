"""Exact top-k by integer inner product: a Voronoi join of queries and data.

Queries and data are grouped by the nearest of a few pivots. For a group of queries with
pivot p and radius u (the largest distance of its queries from p), a data vector s scores
between <p, s> - u|s| and <p, s> + u|s| with every query of the group. Summaries of the
whole data give each group a bound: the (k+1)-th largest of the lower ends, over distinct
ids, which at least k candidates of every query reach. A data vector is replicated to a
group only if its upper end reaches the group's bound. Within a group the data are dealt
to blocks by a hash of their id, each block is solved by itself, and the blocks' best k
are merged.

Defined results: vectors that are null or hold null or non-finite components (before or
after scaling) take no part, nor do rows with a null id; vectors of different lengths are
never compared, empty ones score 0; a repeated id counts once, with its best score; ties
go to the smaller id; scores beyond a long are given as the nearest long; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, tasks

#: Queries that a group holds, about, and the least number of groups.
GROUP, LEAST_GROUPS = 16384, 4
#: Data rows of a block, about.
BLOCK = 32768
EXACT = float(1 << 53)


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as whole doubles."""
    return F.transform(vector.cast("array<double>"), lambda x: F.nanvl(x, F.lit(float("inf"))) * F.lit(float(scale)))


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(len(ids), dim)
    return ids, v


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore", invalid="ignore"):
        d = (points ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * points @ pivots.T
        cell = d.argmin(1)
        return cell, np.sqrt(((points - pivots[cell]) ** 2).sum(1))


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles, as longs."""
    with np.errstate(over="ignore"):
        top = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    if top < EXACT:
        return (queries @ data.T).astype(np.int64)
    a, b = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (queries, data))
    exact = a.dot(b.T) if data.shape[1] else np.zeros((len(a), len(b)), object)
    return np.array([[min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in r] for r in exact], np.int64).reshape(len(a), len(b))


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The k best of ``data`` for every query, own row left out, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data[order]
    unique, starts = np.unique(ids, return_index=True)
    step = max(1, (1 << 22) // max(1, len(ids)))
    for i in range(0, len(query_ids), step):
        s = scores(queries[i:i + step], data)
        if len(unique) < len(ids):
            s = np.maximum.reduceat(s, starts, axis=1)
        for q, row in zip(query_ids[i:i + step].tolist(), s):
            at = np.nonzero(unique != q)[0] if q in (unique[min(np.searchsorted(unique, q), len(unique) - 1)],) else slice(None)
            row, near = row[at], unique[at]
            if len(row) > k:
                bound = np.partition(row, len(row) - k)[len(row) - k]
                above = np.nonzero(row > bound)[0]
                take = np.concatenate([above, np.nonzero(row == bound)[0][:k - len(above)]])
            else:
                take = np.arange(len(row))
            yield pd.DataFrame({"query_id": q, "vec_id": near[take], "score": row[take]})


def _join(rows: DataFrame, is_query: Column, dim: int, n: int, nq: int, k: int, group: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    cells = max(LEAST_GROUPS, math.ceil(nq / group))
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v")
    queries = rows.where(is_query)
    # pivots: a bounded sample of the queries, by a hash of their ids
    picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(cells).collect()
    pivots = np.unique(np.array([np.frombuffer(r.v, np.float64) for r in picked]).reshape(len(picked), dim), axis=0)

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.full(len(pivots), -1.0)
        for batch in batches:
            cell, d = _nearest(_rows(batch, dim)[1], pivots)
            np.maximum.at(out, cell, d)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(len(pivots), dtype=np.int32), "radius": out})

    radius = np.full(len(pivots), -1.0)
    for r in queries.mapInArrow(radii, "cell int, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radius[r.cell] = r.radius * (1 + 1e-9) if r.radius > 0 else r.radius
    live = np.nonzero(radius >= 0)[0]

    def ends(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper end of the scores of each vector with each live group, with room for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            mid = v @ pivots[live].T
            size = np.sqrt((v ** 2).sum(1))[:, None]
            room = size * radius[live][None, :] + 1e-9 * size * np.sqrt((pivots[live] ** 2).sum(1))[None, :] + 1e-6
            low, high = mid - room, mid + room
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)  # beyond a double: no bound

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in live]
        for batch in batches:
            ids, v = _rows(batch, dim)
            if len(ids):
                low = ends(v)[0]
                for j in range(len(live)):
                    # the best k + 1 of a batch by distinct id: repeated ids are dropped before the cut
                    o = np.lexsort((-low[:, j], ids))
                    o = o[np.concatenate([[True], ids[o][1:] != ids[o][:-1]])]
                    o = o[np.argsort(-low[o, j], kind="stable")[:k + 1]]
                    for i, x in zip(ids[o].tolist(), low[o, j].tolist()):
                        kept[j][i] = max(x, kept[j].get(i, x))
                    kept[j] = dict(sorted(kept[j].items(), key=lambda e: -e[1])[:k + 1])
        rows = [(j, i, x) for j, d in enumerate(kept) for i, x in d.items()]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("g", "vec_id", "low"), map(list, zip(*rows)))),
                                             schema=pa.schema([("g", pa.int32()), ("vec_id", pa.int64()), ("low", pa.float64())]))

    ranked = (rows.mapInArrow(lower, "g int, vec_id long, low double").groupBy("g", "vec_id").agg(F.max("low").alias("low"))
              .withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("low")))).where(F.col("r") == k + 1))
    bound = np.full(len(live), -np.inf)
    for r in ranked.collect():  # a row for each group
        bound[r.g] = r.low

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = _rows(batch, dim)
            if not len(ids):
                continue
            need = ends(v)[1] >= bound[None, :]
            for j in range(len(live)):
                take = pa.array(np.nonzero(need[:, j])[0])
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), j, np.int32)), batch.column("vec_id").take(take),
                                                      batch.column("v").take(take)], names=["g", "vec_id", "v"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {int(c): j for j, c in enumerate(live)}
        for batch in batches:
            _, v = _rows(batch, dim)
            cell = _nearest(v, pivots)[0]
            yield pa.RecordBatch.from_arrays([pa.array([at[int(c)] for c in cell], pa.int32()), batch.column("vec_id"), batch.column("v")],
                                             names=["g", "vec_id", "v"])

    blocks = max(1, math.ceil(n / block))
    parts = max(1, math.ceil(nq / group))  # a group of many queries is split too
    ddl = "g int, vec_id long, v binary"
    data = rows.mapInArrow(replicate, ddl).select("g", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"),
                                                  F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(False).alias("query"), "vec_id", "v")
    asked = queries.mapInArrow(assign, ddl).select("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
                                                   F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("p"), F.lit(True).alias("query"), "vec_id", "v")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        is_q, ids = pdf["query"].to_numpy(), pdf["vec_id"].to_numpy()
        v = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(ids), dim)
        got = list(best(ids[is_q], v[is_q], ids[~is_q], v[~is_q], k)) if is_q.any() and not is_q.all() else []
        return pd.concat(got) if got else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return (data.unionByName(asked).repartition(tasks(spark), "g", "b", "p").groupBy("g", "b", "p")
            .applyInPandas(solve, "query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding", group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products of floor(scale * x).

    ``is_query`` is a condition on ``vec_id``; candidates are all rows but the query's own.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("raw"))
    # floor keeps a whole double a double: beyond 2^53 every double is whole
    grown = scaled(F.col("raw"), scale)
    rows = rows.where("vec_id is not null and raw is not null").withColumn("x", grown)
    rows = rows.where(F.coalesce(F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False)))

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            offsets = lists.offsets.to_numpy()
            values = np.floor(lists.values.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(np.diff(offsets).astype(np.int32)),
                 pa.array([values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())], names=["vec_id", "dim", "v"])

    rows = frozen(rows.select("vec_id", "x").mapInArrow(as_bytes, "vec_id long, dim int, v binary"), "knn-vectors")
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("nq")).where("nq > 0").collect()
    found = [_join(rows, is_query, r.dim, r.n, r.nq, k, group, block) for r in dims]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
