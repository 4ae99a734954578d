"""Gaps and islands, interval merging, arrivals and change detection: windows over one shuffle by key.

With block (a width in seconds) a key's rows are spread over many tasks by a two-level scan (operators/scans),
with the same results; without it one task takes a key, which is the cheaper way for many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.operators import scans


def lagged(rows: DataFrame, keys: list[str], order: list[str], block: float | None, first: str | None = None, **columns: str) -> DataFrame:
    """The values of the row before, null for the first: name=column. first: a column that tells whether it is the first."""
    if block is not None:
        return scans.lagged(rows, keys, order[0], order, block, first, **columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    told = {first: F.row_number().over(w) == 1} if first else {}
    return rows.withColumns({name: F.lag(c).over(w) for name, c in columns.items()} | told)


def with_island(rows: DataFrame, keys: list[str], order: list[str], begins: Column, block: float | None = None, first: str | None = None) -> DataFrame:
    """island: how many rows up to this one begin a new one (the first always does).

    first: the column that tells a key's first row, where lagged() has added it; it is dropped.
    """
    if block is not None:
        return scans.with_island(rows, keys, order[0], order, begins, block, first)
    if first:
        rows = rows.drop(first)
    w = Window.partitionBy(*keys).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 1).when(begins, 1).otherwise(0)
    return rows.withColumn("i_flag", flag).withColumn("island", F.sum("i_flag").over(w)).drop("i_flag")


def gap_islands(rows: DataFrame, keys: list[str], start: str, end: str, order: list[str], gap: float, block: float | None = None) -> DataFrame:
    """Clusters: a row begins a new one where its start lies over `gap` after the end of the row before it."""
    marked = with_island(lagged(rows, keys, order, block, "i_first", p_end=end), keys, order, F.col(start) - F.col("p_end") > gap, block, "i_first")
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("start_sec"), F.max(end).alias("end_sec"), F.count(F.lit(1)).alias("n_rows")).drop("island")


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str, order: list[str], block: float | None = None) -> DataFrame:
    """The union of intervals that overlap or touch, by the largest end so far."""
    if block is not None:
        reached = scans.scan(rows, keys, order[0], order, block, p_end=scans.Scan("max", F.col(end), own=False), i_any=scans.Scan("last", F.lit(1), own=False))
        reached = reached.withColumn("i_first", F.col("i_any").isNull()).drop("i_any")
    else:
        reached = rows.withColumn("p_end", F.max(end).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    marked = with_island(reached, keys, order, F.col(start) > F.col("p_end"), block, "i_first" if block is not None else None)
    return marked.groupBy(*keys, "island").agg(F.min(start).alias("start_sec"), F.max(end).alias("end_sec"), F.count(F.lit(1)).alias("n_rows")).drop("island")


def first_burst(rows: DataFrame, keys: list[str], ts: str, order: list[str], k: int, within: float) -> DataFrame:
    """Arrival of the first k rows within `within` seconds of each other; else the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = rows.withColumn("k_ts", F.lead(ts, k - 1).over(w))
    burst = F.min(F.when(F.col("k_ts") - F.col(ts) <= within, F.col(ts)))
    return ahead.groupBy(*keys).agg(F.coalesce(burst, F.min(ts)).alias("arrival"), burst.isNotNull().alias("is_burst"))


def shifts(rows: DataFrame, keys: list[str], value: str, order: list[str], least: float = 0.5, block: float | None = None) -> DataFrame:
    """Consecutive changes of at least `least`; a reversal crosses zero."""
    prior = lagged(rows, keys, order, block, previous=value).where("previous is not null")
    change = prior.withColumn("delta", F.col(value) - F.col("previous")).withColumn("is_reversal", F.col(value) * F.col("previous") < 0)
    return change.where(F.abs("delta") >= least)


def volatility(rows: DataFrame, keys: list[str], value: str, order: list[str], span: float = 2.0, block: float | None = None) -> DataFrame:
    """Sum of absolute changes over the largest possible sum, at most 1; fewer than two rows: 0."""
    steps = lagged(rows, keys, order, block, v_before=value).withColumn("step", F.abs(F.col(value) - F.col("v_before")))
    n = F.count(F.lit(1))
    return steps.groupBy(*keys).agg(n.alias("n_rows"), F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.sum("step"), F.lit(0.0)) / (span * (n - 1)))).alias("volatility"))


def turns(rows: DataFrame, keys: list[str], speaker: str, start: str, end: str, order: list[str], least: float = 0.5, cut_in: float = 0.3, block: float | None = None) -> DataFrame:
    """Turns of at least `least` seconds, with whether each interrupts the other speaker before it."""
    marked = lagged(rows.where(F.col(end) - F.col(start) >= least), keys, order, block, p_speaker=speaker, p_end=end)
    cuts = F.coalesce((F.col("p_speaker") != F.col(speaker)) & (F.col(start) < F.col("p_end") - cut_in), F.lit(False))
    return marked.withColumn("interrupts_previous", cuts).drop("p_speaker", "p_end")


def talk_share(rows: DataFrame, keys: list[str], speaker: str, start: str, end: str) -> DataFrame:
    """Talk time, its share in the key, and interruptions of each speaker (from turns())."""
    per = rows.groupBy(*keys, speaker).agg(F.sum(F.col(end) - F.col(start)).alias("talk_sec"), F.count(F.lit(1)).alias("n_turns"), F.sum(F.col("interrupts_previous").cast("long")).alias("n_interrupts"))
    return per.withColumn("talk_pct", 100 * F.col("talk_sec") / F.sum("talk_sec").over(Window.partitionBy(*keys)))
