"""Centroid clustering against plain Python integers."""
import hashlib
import math

import numpy as np
import pytest

from quillscan.llm import centroids


def brute(rows, k, rounds, dims):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    first = sorted(kept, key=lambda e: (e[0] is None, hashlib.sha256(f"2:{e[0]}".encode()).hexdigest() if e[0] is not None else "", e[1]))
    cs = [list(v) for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs)) for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for n in range(len(cs)):
            mine = [v for (_, v), (_, at) in zip(kept, where) if at == n]
            if mine:
                cs[n] = [sum(x) // len(mine) for x in zip(*mine)]
    most = (1 << 63) - 1
    where = assign()
    each = {n: sum(d for d, at in where if at == n) for n in range(len(cs))}
    return sorted(((i, n, min(d, most), min(each[n], most), min(sum(min(x, most) for x in each.values()), most) if max(each.values()) <= most else most,
                    hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, where)), key=repr)


def run(make, rows, k, rounds, dims, block=centroids.BLOCK):
    docs = make(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(docs, k=k, rounds=rounds, dims=dims, block=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 2048])
def test_odd_rows_ties_and_repeats(make, block):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=5) + 3 * np.eye(5)[i % 5]]) for i in range(150)]
    rows += [(500 + i, [1.0, 0.0, 0.0, 0.0, -0.001]) for i in range(90)]  # a hot vector
    rows += rows[:20] + [(7, [0.5] * 5), (None, [0.25] * 5), (None, [-0.25] * 5)]
    rows += [(900, None), (901, []), (902, [1.0]), (903, [None] + [1.0] * 4), (904, [float("nan")] * 5), (905, [float("inf")] + [0.0] * 4)]
    assert run(make, rows, 6, 4, 5, block) == brute(rows, 6, 4, 5)


def test_large_components(make):
    rows = [(i, [float((i % 7) * 2.0 ** 30), -float(i) * 2.0 ** 21, 1.0 + i]) for i in range(40)]
    assert run(make, rows, 4, 3, 3) == brute(rows, 4, 3, 3)
    rows += [(100 + i, [1e200 * i, 0.0, 0.0]) for i in range(3)]
    got = run(make, rows, 4, 3, 3)
    assert [(r[0], r[1], r[2], r[5]) for r in got] == [(r[0], r[1], r[2], r[5]) for r in brute(rows, 4, 3, 3)]


def test_few_vectors_and_none(make):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0])]
    assert run(make, rows, 40, 5, 2) == brute(rows, 40, 5, 2)
    assert run(make, [], 40, 5, 2) == [] and run(make, [(1, None)], 40, 5, 2) == []


def test_curve_is_hilbert():
    """Neighbours along the curve differ by one step in one component, and every cell occurs once."""
    for dims, bits in ((2, 3), (3, 2)):
        grid = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        keys = centroids.hilbert_keys(grid, bits)
        walk = grid[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(keys)
        # keys interleave one bit plane after another
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_boxes_keep_every_nearest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        c, v = rng.integers(-50, 50, (12, 4)), rng.integers(-20, 20, (30, 4)) + rng.integers(-40, 40, 4)
        at = set(centroids.box_candidates(v.min(0), v.max(0), c).tolist())
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        assert set(np.nonzero(d == d.min(1, keepdims=True))[1].tolist()) <= at
