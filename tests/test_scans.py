"""Two-level scans against plain windows, and one key in many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vodlens.operators import islands, media, scans, temporal


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    out, t = [], 0.0
    for k in range(2_000):
        t += r.choice([0.0, 0.0, 0.5, 1.0, 9.0, 120.0 if k % 400 == 0 else 0.1])
        out.append((1 if k % 4 else None, k, t, t + r.random() * 3, r.choice([1.0, -1.0, 0.5, None]), r.choice("abc")))
    out += [(2, 5_000 + k, None if k == 0 else float(k), 1.0 + k, 1.0, "a") for k in range(4)] + [(3, 6_000, 5.0, 6.0, None, "b")]
    return spark.createDataFrame(out, "s long, i long, t double, e double, v double, g string")


ORDER = ["t", "i"]


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
    assert key(a) == key(b)


@pytest.mark.parametrize("block", [0.7, 10.0, 1e9])
def test_scans_equal_windows(spark, rows, block):
    w = Window.partitionBy("s").orderBy(*ORDER)
    before, after = Window.unboundedPreceding, Window.unboundedFollowing
    got = scans.scan(
        rows, ["s"], "t", ORDER, block, total=scans.Scan("sum", F.col("i")), earlier=scans.Scan("sum", F.col("i"), own=False), top=scans.Scan("max", F.col("e"), own=False), low=scans.Scan("min", F.col("v")),
        held=scans.Scan("last", F.col("v")), ahead=scans.Scan("next", F.col("v")), then=scans.Scan("next", F.col("v"), own=False), row=scans.Scan("last", F.struct("v"), own=False),
    )
    want = rows.withColumns({
        "total": F.sum("i").over(w.rowsBetween(before, 0)), "earlier": F.sum("i").over(w.rowsBetween(before, -1)), "top": F.max("e").over(w.rowsBetween(before, -1)), "low": F.min("v").over(w.rowsBetween(before, 0)),
        "held": F.last("v", ignorenulls=True).over(w.rowsBetween(before, 0)), "ahead": F.first("v", ignorenulls=True).over(w.rowsBetween(0, after)), "then": F.first("v", ignorenulls=True).over(w.rowsBetween(1, after)),
        "row": F.lag(F.struct("v")).over(w),
    })
    same(got, want)


@pytest.mark.parametrize("block", [0.7, 30.0])
def test_operators_equal_their_plain_form(spark, rows, block):
    clean = rows.where("t is not null")
    for f in (
        lambda **o: islands.gap_islands(clean, ["s"], "t", "e", ORDER, 5.0, **o),
        lambda **o: islands.merge_intervals(clean, ["s"], "t", "e", ORDER, **o),
        lambda **o: islands.shifts(clean, ["s"], "v", ORDER, **o),
        lambda **o: islands.volatility(clean, ["s"], "v", ORDER, **o),
        lambda **o: islands.turns(clean, ["s"], "g", "t", "e", ORDER, **o),
        lambda **o: temporal.carry_forward(clean.withColumn("t", F.col("t") + F.col("i") * 1e-6), ["s"], "t", ["v"], **o),
        lambda **o: media.guests(clean.withColumnsRenamed({"t": "start_sec", "e": "end_sec", "i": "segment_id"}), ["s"], "g", 5.0, **o),
        lambda **o: temporal.asof_forward(clean.where("i % 3 = 0"), clean.where("i % 3 = 1"), ["s"], "t", "t", 2.0, "i", ["i", "v"], **o),
    ):
        same(f(block=block), f())


def test_backward_asof(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5), (1, 100.0), (2, 5.0), (1, None)], "s long, t double")
    right = spark.createDataFrame([(1, 1.0, 10), (1, 5.0, 11), (1, 5.0, 12), (1, 7.0, 13)], "s long, t double, i long")
    for block in (0.5, 3.0, 1e6):
        got = scans.asof(left, right, ["s"], "t", "t", "i", ["i"], block, tolerance=10.0, forward=False)
        assert sorted(((r.s, r.t, r.r_i) for r in got.collect()), key=repr) == sorted([(1, 5.0, 12), (1, 0.5, None), (1, 100.0, None), (2, 5.0, None), (1, None, None)], key=repr)


def test_one_key_is_worked_on_by_many_tasks(spark, rows):
    one = rows.where("s = 1 AND t is not null")
    width = scans.block_width(one, "t", 100)
    got = scans.scan(one, ["s"], "t", ORDER, width, n=scans.Scan("sum", F.lit(1))).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.groupBy("task").count().count() == 4  # all of the session's shuffle partitions
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_order_must_begin_with_time(rows):
    with pytest.raises(ValueError):
        scans.scan(rows, ["s"], "t", ["i"], 1.0, n=scans.Scan("sum", F.lit(1)))
