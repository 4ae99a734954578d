"""Exact top-k: components of any finite size, many query blocks in one job, against Python integers."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from vodlens.llm import topk

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, k, every):
    ints = [(i, [floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    out = []
    for i, q in {(i, tuple(q)) for i, q in ints if i % every == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in ints if j != i and len(x) == len(q)))[:k]
        out += [(i, n + 1, j, -s if -(2**63) <= -s < 2**63 else None) for n, (s, j) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1_024, 3])
@pytest.mark.parametrize("size", [1.0, 3e7, 1e15, 1e30, 1e300])
def test_any_size(spark, block, size):
    r = np.random.default_rng(4)
    rows = [(k, (r.normal(size=6) * (size if k % 7 in (0, 3) else 1.0)).tolist()) for k in range(90)]
    rows += [(90, [1.7e308, -1.7e308, 0.0, 0.0, 0.0, 1.0]), (200, [0.0] * 6)]
    got = topk.search(spark.createDataFrame(rows, VECTORS), every=10, block=block, group=20, pivots=4, sample=30)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5, 10)


def test_large_but_scores_fit(spark):
    """Components beyond 2**31 after scaling take part, as queries and as candidates."""
    rows = [(0, [3e7, 0.0, 1.0]), (50, [0.0, 3e7, 1.0]), *[(k, [1.0 / k, float(k), -1.0]) for k in range(1, 20)]]
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    assert got == brute(rows, 5, 50) and {r[0] for r in got} == {0, 50} and all(r[3] is not None for r in got)


def test_bounds_hold_and_eliminate():
    r = np.random.default_rng(9)
    centres = r.normal(size=(20, 24)) * 3
    raw = centres[r.integers(0, 20, 4_000)] + r.normal(size=(4_000, 24)) * 0.2
    pivots = topk.far_apart(topk.whole(raw[:500]), 32)
    rows = topk.Vectors(np.arange(4_000), raw, topk.distances(topk.whole(raw), pivots))
    taken = 0
    for j in range(0, 4_000, 400):
        bound = rows.bounds(float(rows.square[j]), rows.dist[j])
        assert (bound >= rows.x @ rows.x[j]).all()
        best = topk.Best(5)
        taken += topk.eliminate(best, (j, rows.x[j], raw[j], True, rows.dist[j], float(rows.square[j])), rows)
        score = np.where(rows.ids == j, topk.LEAST, rows.x @ rows.x[j])
        assert sorted(best.score.tolist(), reverse=True) == sorted(score.tolist(), reverse=True)[:5]
    assert taken < 10 * 4_000 / 2


def clustered(n, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(15, 16)) * 4
    rows = [(k, (centres[k % 15] + r.normal(size=16) * 0.1).tolist()) for k in range(n)]
    return rows + [(n + k, [0.5] * 16) for k in range(n // 3)]  # a third are copies


def test_queries_go_to_few_groups(spark):
    """The share of (query, group) pairs that are visited, on clustered vectors; no group that holds a true result is left out."""
    rows = clustered(3_000)
    table = topk.usable(spark.createDataFrame(rows, VECTORS).repartition(4), "vec_id", "embedding")
    raw = np.array([v for _, v in rows])
    pivots = topk.far_apart(topk.whole(raw[:500]), 32)
    ranged = topk.stored(topk._ranged(topk.pivot_table(table, {16: pivots}), 40), "groups")
    routes = topk.Routes([tuple(r) for r in topk._summaries(ranged).collect()])
    place = {r.vec_id: r.g for r in ranged.select("g", "vec_id").collect()}
    assert len(set(place.values())) >= 30
    x = topk.whole(raw).astype(np.int64)
    every, sample = topk.Vectors(np.arange(len(rows)), raw, topk.distances(topk.whole(raw), pivots)), np.arange(500)
    visited = 0
    for q in range(0, len(rows), 50):
        score = np.where(np.arange(len(rows)) == q, topk.LEAST, x @ x[q])
        floor = np.sort(np.where(sample == q, topk.LEAST, (x @ x[q])[sample]))[-5]
        groups = set(routes.groups(16, float(every.square[q]), every.dist[q], float(floor)).tolist())
        visited += len(groups)
        best = sorted(range(len(rows)), key=lambda j: (-int(score[j]), j))[:5]
        assert {place[j] for j in best} <= groups
    assert visited < 0.5 * len(set(place.values())) * len(range(0, len(rows), 50))
    topk.drop_stored(ranged)


def test_routed_search_is_exact(spark):
    rows = clustered(600)
    got = topk.search(spark.createDataFrame(rows, VECTORS).repartition(3), every=20, block=8, group=50, pivots=8, sample=100)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 5, 20)
