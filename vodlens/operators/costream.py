"""Co-stream operators: clock offsets, alignment, audience comparison, cascades and clip candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.functions import lexicons as L
from vodlens.operators.islands import first_burst
from vodlens.operators.temporal import best_lag, nearest


def unified(rows: DataFrame, offsets: DataFrame, ts: str, channel: str = "channel_id") -> DataFrame:
    """unified_ts: the row's time less its channel's offset (unknown channels: none)."""
    o = offsets.select(channel, F.col("offset_sec"))
    return rows.join(o, channel, "left").withColumn("unified_ts", F.col(ts) - F.coalesce("offset_sec", F.lit(0.0))).drop("offset_sec")


def correlation_offset(signals: DataFrame, keys: list[str], reach: int, step: float) -> DataFrame:
    """Offset of signal b against a by cross-correlation over -reach..reach bins, with its confidence."""
    lag = best_lag(signals, keys, -reach, reach)
    return lag.select(*keys, (F.col("lag") * step).alias("offset_sec"), C.clamp(F.col("score") / F.col("n_bins"), 0.0, 1.0).alias("confidence"))


def trigger_offset(reference: DataFrame, target: DataFrame, keys: list[str], ts: str, item: str, reach: float = 8.0) -> DataFrame:
    """Median difference of each reference trigger's nearest target trigger, with its spread (MAD)."""
    r = reference.select(*keys, F.col(item).alias("r_id"), F.col(ts).alias("r_ts"))
    pairs = nearest(r, target, keys, "r_ts", ts, reach, item).withColumn("d", F.col("n_ts") - F.col("r_ts"))
    mid = pairs.withColumn("m", F.median("d").over(Window.partitionBy(*keys)))
    return mid.groupBy(*keys).agg(F.first("m").alias("offset_sec"), F.median(F.abs(F.col("d") - F.col("m"))).alias("mad"), F.count(F.lit(1)).alias("n_pairs"))


def message_sentiment(content):
    """Mean cross-platform polarity of a message's words (lower case, punctuation off their ends)."""
    table = C.literal_map(L.CROSS_POLARITY)
    hits = F.filter(F.transform(C.words(F.lower(content)), lambda w: F.try_element_at(table, F.btrim(w, F.lit("!?.,:;\"'()[]")))), lambda x: x.isNotNull())
    total = F.aggregate(hits, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(hits) > 0, total / F.size(hits)).otherwise(0.0)


def sentiment_timeline(aligned: DataFrame, keys: list[str], platform: str = "platform", channel: str = "channel_id", width: float = 10.0, least: int = 3, diverge: float = 0.75) -> DataFrame:
    """Per bucket: each platform's mean sentiment, their spread, agreement and divergence."""
    start = aligned.groupBy(*keys).agg(F.min("unified_ts").alias("first"))
    rows = aligned.withColumn("s", message_sentiment(F.col("content"))).join(start, keys).withColumn("bucket_index", F.floor((F.col("unified_ts") - F.col("first")) / width).cast("long"))
    per = rows.groupBy(*keys, "bucket_index", platform).agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*keys, "bucket_index").agg(F.sum("n").alias("n_messages"), F.count(F.lit(1)).alias("n_platforms"), (F.max(F.col("s") / F.col("n")) - F.min(F.col("s") / F.col("n"))).alias("spread"))
    out = out.where(F.col("n_messages") >= least)
    return out.withColumn("agreement", C.clamp(1 - F.col("spread") / 2, 0.0, 1.0)).withColumn("divergence_detected", F.col("spread") >= diverge)


def agreement_summary(timeline: DataFrame, keys: list[str]) -> DataFrame:
    return timeline.groupBy(*keys).agg(F.avg("agreement").alias("mean_agreement"), F.sum(F.col("divergence_detected").cast("long")).alias("n_divergent"), F.count(F.lit(1)).alias("n_points"))


def most_divergent(timeline: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The points of each key with the widest spread (ties: earlier)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round("spread", 9)), "bucket_index")
    return timeline.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def cascade(aligned: DataFrame, token: str, channel: str = "channel_id", k: int = 3, within: float = 10.0) -> DataFrame:
    """When a word arrives in each channel, and how long after the first."""
    hits = aligned.where(F.array_contains(C.words(F.lower("content")), token.lower()))
    arrived = first_burst(hits, [channel], "unified_ts", ["unified_ts", "message_id"], k, within)
    # One row per channel is left: a window over all of them is a window over a few rows.
    w = Window.partitionBy(F.lit(token))
    return arrived.select(F.lit(token).alias("token"), channel, "arrival", (F.col("arrival") - F.min("arrival").over(w)).alias("delay_sec"))


def multi_angle(points: DataFrame, aligned: DataFrame, keys: list[str], span: float = 30.0) -> DataFrame:
    """Virality of each timeline point: sentiment spread, messages in its span, divergence and agreement."""
    from vodlens.operators.temporal import range_join

    windows = points.select(*keys, "bucket_index", "timestamp_sec", "spread", "agreement", "divergence_detected", (F.col("timestamp_sec") - span / 2).alias("w_low"), (F.col("timestamp_sec") + span / 2).alias("w_high"))
    near = range_join(aligned.select(*keys, "unified_ts"), windows, keys, "unified_ts", "w_low", "w_high", span)
    per = near.groupBy(*keys, "bucket_index").agg(F.count(F.lit(1)).alias("n_messages"))
    out = windows.join(per, [*keys, "bucket_index"], "left").fillna(0, ["n_messages"])
    score = 40 * F.abs("spread") + F.least(F.lit(30.0), 1.5 * F.col("n_messages")) + F.when(F.col("divergence_detected"), 20.0).otherwise(0.0) + F.when(F.col("agreement") >= 0.85, 15.0).otherwise(0.0)
    return out.withColumn("virality_score", C.clamp(score, 10.0, 99.0))
