"""Time-series operators: buckets and spines, as-of, overlap, range and nearest joins, carry-forward.

Every join here is an equi-join on time bins or a window over one shuffle; none needs a Cartesian
product. Time is in seconds (double) unless a name says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.operators import scans


def shifted(ts: Column, lag: float) -> Column:
    """Latency shift; early rows clamp to zero."""
    return F.greatest(F.lit(0.0), ts - F.lit(float(lag)))


def bucket(ts: Column, width: float) -> Column:
    return F.floor(ts / F.lit(float(width))).cast("long")


def spine(bounds: DataFrame, keys: list[str], width: float, duration: str = "duration") -> DataFrame:
    """A row for each bucket 0..floor(duration / width) of each key."""
    ids = F.sequence(F.lit(0).cast("long"), bucket(F.col(duration), width))
    return bounds.select(*keys, F.explode(ids).alias("bucket_index")).withColumn("start_sec", F.col("bucket_index") * F.lit(float(width)))


def tumbling_counts(rows: DataFrame, bounds: DataFrame, keys: list[str], ts: str, width: float, lag: float = 0.0, **aggregates: Column) -> DataFrame:
    """Dense bucket aggregation: count and velocity of every bucket of the spine, and more aggregates."""
    placed = rows.withColumn("bucket_index", bucket(shifted(F.col(ts), lag), width))
    counts = placed.groupBy(*keys, "bucket_index").agg(F.count(F.lit(1)).alias("message_count"), *[c.alias(k) for k, c in aggregates.items()])
    dense = spine(bounds, keys, width).join(counts, [*keys, "bucket_index"], "left").fillna({"message_count": 0})
    return dense.withColumn("velocity", F.col("message_count") / F.lit(float(width)))


def sliding(rows: DataFrame, ts: Column, size: float, hop: float, origin: Column | float = 0.0) -> DataFrame:
    """A row for each window of `size` every `hop` (from origin) that a row is in: window_start, window_end."""
    start = F.lit(origin) if isinstance(origin, (int, float)) else origin
    last = F.floor((ts - start) / hop)
    first = F.greatest(F.lit(0).cast("long"), F.floor((ts - start - size) / hop) + 1)
    ids = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("w_id", F.explode(ids)).withColumn("window_start", start + F.col("w_id") * hop).withColumn("window_end", F.col("window_start") + size).drop("w_id")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tolerance, tie: str, take: list[str], block: float | None = None) -> DataFrame:
    """As-of left join: the earliest right row at or after left_ts, within tolerance.

    Both sides go through one shuffle by key and one ordered window; rows without a match keep nulls.
    With block (a width of time) a key's rows are spread over many tasks (operators/scans).
    """
    if block is not None:
        return scans.asof(left, right, keys, left_ts, right_ts, tie, take, block, tolerance)
    out = [c for c in left.columns]
    l = left.select(F.struct(*out).alias("l"), *keys, F.col(left_ts).alias("a_ts"), F.lit(0).alias("a_side"), F.lit(None).cast(right.schema[tie].dataType).alias("a_tie"), F.lit(None).cast(struct_type(right, [right_ts, *take])).alias("r"))
    r = right.select(F.lit(None).cast(l.schema["l"].dataType).alias("l"), *keys, F.col(right_ts).alias("a_ts"), F.lit(1).alias("a_side"), F.col(tie).alias("a_tie"), F.struct(right_ts, *take).alias("r"))
    # Backwards, since a frame that ends with the partition is worked out anew for each row.
    after = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in ("a_ts", "a_side", "a_tie")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r).withColumn("n", F.last("r", ignorenulls=True).over(after)).where("a_side = 0")
    near = F.col(f"n.{right_ts}") - F.col("a_ts") <= F.lit(tolerance)
    return both.select("l.*", *[F.when(near, F.col(f"n.{c}")).alias(f"r_{c}") for c in [right_ts, *take]])


def struct_type(df: DataFrame, columns: list[str]):
    """The struct type of some columns."""
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def overlap_buckets(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """A row for each bucket that a non-empty interval overlaps, strictly."""
    w = float(width)
    last = F.ceil(F.col(end) / w) - 1
    ids = F.sequence(F.floor(F.col(start) / w), F.greatest(last, F.floor(F.col(start) / w)))
    return intervals.where(F.col(end) > F.col(start)).withColumn("bucket_index", F.explode(ids))


def range_join(points: DataFrame, windows: DataFrame, keys: list[str], ts: str, low: str, high: str, bin_size: float) -> DataFrame:
    """Inner join of points with the closed windows that hold them, over time bins of `bin_size`."""
    bins = F.sequence(F.floor(F.col(low) / bin_size), F.floor(F.col(high) / bin_size))
    spread = windows.where(F.col(high) >= F.col(low)).withColumn("j_bin", F.explode(bins))
    placed = points.withColumn("j_bin", F.floor(F.col(ts) / bin_size))
    return placed.join(spread, [*keys, "j_bin"]).where(F.col(ts).between(F.col(low), F.col(high))).drop("j_bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: float) -> DataFrame:
    """Inner join of closed intervals that meet, in a point at least: neither ends before the other begins.

    Both sides are spread over time bins, and a pair counts in the first bin that the two share only, so
    that it comes once without a distinct. An interval that ends before it begins meets nothing.
    """
    (a, b), (c, d) = left_span, right_span
    bin_of = lambda x: F.floor(F.col(x) / bin_size)
    spread = lambda df, low, high: df.where(F.col(high) >= F.col(low)).withColumn("o_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    pairs = spread(left, a, b).join(spread(right, c, d), [*keys, "o_bin"])
    return pairs.where((F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("o_bin") == F.greatest(bin_of(a), bin_of(c)))).drop("o_bin")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, reach: float, right_id: str) -> DataFrame:
    """Each left row's nearest right row within reach (ties: earlier, then smaller id); inner.

    One ordered scan over both sides finds the right rows before and after each left row.
    """
    r = right.where(F.col(right_ts).isNotNull()).groupBy(*keys, F.col(right_ts).alias("n_ts")).agg(F.min(F.struct(F.col(right_id).alias("n_id"))).alias("i"))
    r = r.select(*keys, F.col("n_ts").cast("double").alias("a_ts"), F.lit(1).alias("a_side"), F.struct("n_ts", "i.n_id").alias("r"))
    present = F.col(left_ts).isNotNull()
    for k in keys:
        present &= F.col(k).isNotNull()
    l = left.where(present).distinct().select(*keys, F.col(left_ts).cast("double").alias("a_ts"), F.lit(0).alias("a_side"), F.struct(*left.columns).alias("l"))
    both = scans.scan(l.unionByName(r, allowMissingColumns=True), keys, "a_ts", ["a_ts", "a_side"], 24 * reach, p=scans.Scan("last", F.col("r"), own=False), n=scans.Scan("next", F.col("r"), own=False))
    t = F.col(f"l.{left_ts}")
    within = lambda c: F.when(F.col(f"{c}.n_ts").between(t - reach, t + reach), F.struct(F.abs(F.col(f"{c}.n_ts") - t).alias("d"), f"{c}.n_ts", f"{c}.n_id"))
    best = both.where("l IS NOT NULL").select("l", F.least(within("p"), within("n")).alias("b")).where("b IS NOT NULL")
    return best.select("l.*", "b.n_ts", "b.n_id")


def carry_forward(dense: DataFrame, keys: list[str], order: str, columns: list[str], block: float | None = None) -> DataFrame:
    """Last observation carried forward along `order`; with block (a width of it) in many tasks per key."""
    if block is not None:
        return scans.carry_forward(dense, keys, order, columns, block)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dense.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def spikes(dense: DataFrame, keys: list[str], least: float = 2.0, factor: float = 2.2) -> DataFrame:
    """is_spike: velocity at least max(least, factor * mean velocity of the key)."""
    mean = F.avg("velocity").over(Window.partitionBy(*keys))
    return dense.withColumn("is_spike", F.col("velocity") >= F.greatest(F.lit(least), F.lit(factor) * mean))


def z_bursts(dense: DataFrame, keys: list[str], z: float = 2.5, factor: float = 3.0) -> DataFrame:
    """The buckets whose count stands out by population z-score or by a multiple of the mean."""
    w = Window.partitionBy(*keys)
    mean, dev = F.avg("message_count").over(w), F.stddev_pop("message_count").over(w)
    scored = dense.withColumn("mean_count", mean).withColumn("z_score", F.when(dev > 0, (F.col("message_count") - mean) / dev).otherwise(0.0))
    return scored.where((F.col("message_count") > 0) & ((F.col("z_score") >= z) | (F.col("message_count") >= factor * F.col("mean_count"))))


def best_lag(signals: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """The lag (in bins) of the second signal at which the zero-mean, unit-variance dot product is largest.

    signals: keys, bin, a, b. Ties go to the smaller lag; a flat signal gives no row.
    """
    w = Window.partitionBy(*keys)
    unit = {c: F.when(F.stddev_pop(c).over(w) > 0, (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)) for c in ("a", "b")}
    scaled = signals.select(*keys, "bin", *[x.alias(c) for c, x in unit.items()])
    lags = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag")
    a = scaled.where("a is not null").select(*keys, "bin", "a", lags).withColumn("at", F.col("bin") + F.col("lag"))
    b = scaled.where("b is not null").select(*keys, F.col("bin").alias("at"), "b")
    products = a.join(b, [*keys, "at"]).groupBy(*keys, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("score"), F.count(F.lit(1)).alias("n_bins"))
    return products.groupBy(*keys).agg(F.max_by(F.struct("lag", "score", "n_bins"), F.struct(F.round("score", 9), -F.col("lag"))).alias("m")).select(*keys, "m.*")
