"""The inverted-list index: recall, exact search, pruned lists, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vodlens.operators import vector_index as VI


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + 0.35 * rng.normal(size=16)).tolist(), k % 3) for k in range(3_000)]
    rows += [(5_000 + k, [1.0] * 16, 0) for k in range(200)]  # copies
    odd = [(9_001, None, 0), (9_002, [1.0] * 3, 0), (9_003, [float("nan")] * 16, 0), (9_004, [None] * 16, 0), (None, [1.0] * 16, 0), (9_005, [0.0] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>, kind long").repartition(4)
    held = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v, _ in [*rows, odd[-1]]}
    return df, held


def brute(held, ids, k, keep=lambda i: True):
    names = [i for i in sorted(held) if keep(i)]
    x = np.array([held[i] for i in names])
    out = {}
    for q in ids:
        s = np.round(x @ held[q], 9)
        out[q] = [(names[j], s[j]) for j in sorted(range(len(names)), key=lambda j: (-s[j], names[j])) if names[j] != q][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.item, r.sim))
    return out


def test_recall_of_probes_and_exactness(spark, vectors, tmp_path):
    df, held = vectors
    index = VI.build(df, "id", "v", str(tmp_path / "index"), lists=40, keep=["kind"])
    assert index.rows().count() == len(held)
    asked = df.where("id % 50 = 0 OR id = 9005")
    ids = [i for i in held if i % 50 == 0] + [9_005]
    want = brute(held, ids, 10)
    some = found(VI.search(index, asked, "id", "v", 10, probes=6, not_self=True))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in some.get(q, [])}) for q in want if q % 50 == 0)
    assert hits >= 0.9 * 10 * (len(want) - 1)
    for options in ({}, {"block": 7}, {"probes": 1}):
        every = found(VI.search(index, asked, "id", "v", 10, exact=True, not_self=True, **options))
        assert every.keys() == want.keys()
        for q in want:
            assert [i for i, _ in every[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in every[q]], [s for _, s in want[q]])
    kind = found(VI.search(index, asked.where("id = 50"), "id", "v", 5, exact=True, not_self=True, where=F.col("kind") == 1))
    kinds = {r.id: r.kind for r in df.where("id is not null").collect()}
    assert [i for i, _ in kind[50]] == [i for i, _ in brute(held, [50], 5, lambda i: kinds[i] == 1)[50]]


def test_lists_are_pruned_and_exact_search_leaves_some_out(spark, vectors, tmp_path):
    df, held = vectors
    index = VI.build(df, "id", "v", str(tmp_path / "index"), lists=40)
    wanted = np.zeros((1, len(index.centroids)), bool)
    wanted[0, [2, 5]] = True
    scan = VI.scanned(index.rows(), np.array([0]), np.array([held[0]]), wanted, 5)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and "IN (2,5)" in plan
    assert index.rows().select("list").distinct().count() >= 30
    exact = []
    seen = VI.scanned

    def noting(rows, ids, q, wanted, *more, **named):
        exact.append(wanted.mean())
        return seen(rows, ids, q, wanted, *more, **named)

    VI.scanned = noting
    try:
        VI.search(index, df.where("id % 50 = 0 AND id < 3000"), "id", "v", 3, probes=2, exact=True)
    finally:
        VI.scanned = seen
    assert len(exact) == 2 and sum(exact) < 0.9  # the share of (query, list) pairs that the two scans visit


def test_more_rows_and_loading(spark, vectors, tmp_path):
    df, held = vectors
    VI.build(df.where("id < 2000"), "id", "v", str(tmp_path / "index"), lists=20)
    index = VI.load(spark, str(tmp_path / "index"))
    VI.add(index, df.where("id >= 2000"), "id", "v")
    every = found(VI.search(index, df.where("id = 100"), "id", "v", 10, exact=True, not_self=True))
    assert [i for i, _ in every[100]] == [i for i, _ in brute(held, [100], 10)[100]]


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = VI.build(none, "id", "v", str(tmp_path / "index"))
    some = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert VI.search(index, none, "id", "v").count() == 0
    assert VI.search(index, some, "id", "v").count() == 0 and VI.search(index, some, "id", "v", exact=True).count() == 0
