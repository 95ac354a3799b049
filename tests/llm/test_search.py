"""Exact and approximate search against brute force."""
import collections

import duckdb
import numpy as np
import pytest
from llm_data import SF
from pyspark.sql import functions as F

from quillscan.llm import ann, knn, queries


def embeddings():
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    rows = [r for r in rows if r[1] is not None]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)


def brute_scores(ids, v, k, chosen):
    """{query: [(vec_id, score)]}; a repeated id counts once, with its best score."""
    out = {}
    for q in sorted({i for i in ids if chosen(i)}):
        best = {}
        for x in [v[n] for n, i in enumerate(ids) if i == q]:
            for i, y in zip(ids, v):
                if i != q and len(x) == len(y):
                    best[i] = max(best.get(i, -(1 << 80)), sum(a * b for a, b in zip(x, y)))
        out[q] = sorted(((i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for i, s in best.items()), key=lambda e: (-e[1], e[0]))[:k]
    return out


def ranked(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return dict(out)


def test_exact_whole_table(spark):
    ids, x = embeddings()
    v = np.floor(1024 * x).astype(np.int64)
    got = ranked(queries.op2_voronoi(spark, SF).collect())
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 100 == 0)
    for q in got:
        s = v @ v[ids == q][0]
        want = sorted(((i, t) for i, t in zip(ids.tolist(), s.tolist()) if i != q), key=lambda e: (-e[1], e[0]))[:10]
        assert got[q] == want


@pytest.mark.parametrize("group,block", [(1, 7), (16384, 32768), (3, 50)])
def test_exact_blocks_ties_and_repeats(make, group, block):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 3) / 1024]) for i in range(0, 160)]
    rows += [(200 + i, [1.0, 1.0, 0.0]) for i in range(60)] + rows[:30] + [(7, [0.5, 0.5, 0.5])]
    rows += [(300, None), (301, [None, 1.0, 2.0]), (302, [float("nan"), 1.0, 2.0]), (303, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
             (400, [1.0, 2.0]), (401, [2.0, 1.0]), (500, []), (501, [])]
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    docs = make(rows, "vec_id long, embedding array<double>")
    got = ranked(knn.top_k(docs, F.col("vec_id") % 100 == 0, 10, group=group, block=block).collect())
    want = brute_scores([i for i, _ in kept], [v for _, v in kept], 10, lambda i: i % 100 == 0)
    assert got == {q: w for q, w in want.items() if w}


def test_exact_huge_components(make):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [2.0 ** 40, 2.0 ** 30]), (100, [2.0 ** 40, 1.0]), (4, [1e308, 0.0])]
    got = ranked(knn.top_k(make(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    ids = [i for i, _ in rows if i != 4]
    v = [[int(np.floor(1024 * x)) for x in v] for i, v in rows if i != 4]
    assert got == brute_scores(ids, v, 10, lambda i: i % 100 == 0)


def test_exact_empty(make):
    docs = make([], "vec_id long, embedding array<float>")
    assert knn.top_k(docs, F.col("vec_id") % 100 == 0).collect() == []
    one = make([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert knn.top_k(one, F.col("vec_id") % 100 == 0).collect() == []


def test_exact_prunes(make):
    """Far groups of short vectors are not replicated, and the result stays exact."""
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in (rng.normal(size=8) * 0.01 + np.eye(8)[i % 4] * (1 + i % 4))]) for i in range(400)]
    v = [[int(np.floor(1024 * x)) for x in r[1]] for r in rows]
    got = ranked(knn.top_k(make(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect())
    assert got == brute_scores([r[0] for r in rows], v, 10, lambda i: i % 100 == 0)


def test_approximate_recall(spark):
    ids, x = embeddings()
    got = ranked(queries.op3_collisions(spark, SF).collect())
    hits = total = 0
    for q in [i for i in ids.tolist() if i % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        near = sorted(((e, i) for e, i in zip(d.tolist(), ids.tolist()) if i != q))[:10]
        hits += len({i for _, i in near} & {i for i, _ in got[q]})
        total += len(near)
        for i, s in got[q]:
            assert abs(s - d[ids == i][0]) < 1e-12
        assert got[q] == sorted(got[q], key=lambda e: (e[1], e[0]))
    assert hits / total >= 0.9


@pytest.mark.parametrize("shard,block", [(40, 1), (32768, 4096)])
def test_approximate_odd_rows(make, shard, block):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(a) for a in rng.normal(size=6)]) for i in range(120)] + [(200 + i, [1.0] * 6) for i in range(50)]
    rows += rows[:20] + [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [None] + [1.0] * 5), (None, [1.0] * 6),
                         (400, [1.0, 2.0]), (401, [2.0, 1.0]), (500, []), (600, [1e200] * 6)]
    got = ranked(ann.search(make(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, shard=shard, query_block=block).collect())
    assert set(got) == {0, 100, 200, 400, 600} and got[400] == [(401, 2 ** 0.5)]
    assert got[200] == [(201 + i, 0.0) for i in range(10)] and all(len({i for i, _ in g}) == len(g) for g in got.values())
    assert ann.search(make([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_all_alike(make):
    docs = make([(i, [2.0, 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    assert ranked(ann.search(docs, F.col("vec_id") == 5, 3).collect()) == {5: [(0, 0.0), (1, 0.0), (2, 0.0)]}
