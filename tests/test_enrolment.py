"""The ordered fold over blocks against the sequential one."""

import numpy as np
import pytest

from vodlens.operators import enrolment


def sequential(samples):
    centroid, n = None, 0
    for x in map(np.array, samples):
        if centroid is None:
            centroid = x
        else:
            centroid = (n * centroid + x) / (n + 1)
            size = np.linalg.norm(centroid)
            centroid = centroid / size if size > 0 else centroid
        n += 1
    return n, centroid


@pytest.mark.parametrize("rows_per_block", [10**6, 150, 37])
def test_blocks_equal_the_sequential_fold(spark, rows_per_block):
    rng = np.random.default_rng(6)
    rows = []
    for who, n in (("ann", 1_000), ("bob", 3), ("cid", 1), ("dee", 40)):
        base = rng.normal(size=8)
        for k in range(n):
            rows.append((who, k // 3, (base + rng.normal(size=8) * (2.0 if who == "ann" else 0.2)).tolist()))  # ties in the order
    rows += [("bob", 9, rows[-1][2])] * 5  # repeats
    rows += [("eve", 0, [1.0, 0.0] * 4), ("eve", 1, [-1.0, 0.0] * 4), ("eve", 2, [0.0] * 8)]  # a sum of length zero
    odd = [("ann", 1, None), ("bob", 1, [None] * 8), ("bob", 1, [float("nan")] * 8), (None, 1, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "who string, t long, v array<double>").repartition(3)
    got = {r.who: (r.sample_count, r.centroid) for r in enrolment.enrol(df, "who", ["t"], "v", rows_per_block).collect()}
    assert set(got) == {r[0] for r in rows}
    for who in got:
        n, want = sequential([v for _, _, v in sorted(r for r in rows if r[0] == who)])
        assert got[who][0] == n and np.allclose(got[who][1], want, atol=1e-11), who


def test_empty(spark):
    none = spark.createDataFrame([], "who string, t long, v array<double>")
    assert enrolment.enrol(none, "who", ["t"], "v").collect() == []
