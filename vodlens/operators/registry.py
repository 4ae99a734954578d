"""Registries: audit runs and their baseline, telemetry, enqueueing, status updates, observations and the lexicon's life."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.operators import store

STAGE = "run_id string, stage_name string, start_time timestamp, end_time timestamp, duration_sec double, status string, error_message string"


def record_runs(runs: DataFrame, batch: DataFrame) -> DataFrame:
    """Upserts runs by run_id. One run at most is the baseline: the latest of the batch's, else the one there was."""
    newest = batch.where("is_baseline").agg(F.max_by("run_id", F.struct("timestamp", "run_id")).alias("chosen"))  # one row
    both = store.upsert(runs, batch, ["run_id"]).crossJoin(F.broadcast(newest))
    return both.withColumn("is_baseline", F.coalesce(F.col("run_id") == F.col("chosen"), F.col("is_baseline"))).drop("chosen")


def baseline(runs: DataFrame) -> DataFrame:
    return runs.where("is_baseline").orderBy(F.desc("timestamp"), F.desc("run_id")).limit(1)


def recent(runs: DataFrame, limit: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("run_id")).limit(limit)


class StageLog:
    """Rows of stages of one run, timed on the driver, for the telemetry table."""

    def __init__(self, run_id: str):
        self.run_id, self.rows = run_id, []

    @contextmanager
    def stage(self, name: str):
        began, status, error = time.time(), "SUCCESS", None
        try:
            yield self
        except Exception as e:
            status, error = "ERROR", str(e)
            raise
        finally:
            ended = time.time()
            self.rows.append((self.run_id, name, began, ended, round(ended - began, 3), status, error))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.rows, STAGE.replace(" timestamp", " double"))
        return rows.withColumns({c: F.timestamp_micros((F.col(c) * 1e6).cast("long")) for c in ("start_time", "end_time")})


def run_totals(stages: DataFrame, media_sec: Column | float | None = None) -> DataFrame:
    """Per run: stages, failures, total seconds and, with the length of the media, the real-time factor."""
    per = stages.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_stages"), F.sum((F.col("status") == "ERROR").cast("long")).alias("n_failed"), F.sum("duration_sec").alias("total_sec"))
    if media_sec is None:
        return per
    return per.withColumn("real_time_factor", F.col("total_sec") / (F.lit(float(media_sec)) if isinstance(media_sec, (int, float)) else media_sec))


def enqueued(requests: DataFrame, targets: DataFrame, vods: DataFrame, target: str, vod: str) -> DataFrame:
    """Requests with their status: unknown targets are refused, known recordings kept as they are, others queued."""
    known = targets.select(target).distinct().withColumn("has_target", F.lit(True))
    there = vods.select(vod).distinct().withColumn("has_vod", F.lit(True))
    j = requests.join(known, target, "left").join(there, vod, "left")
    status = F.when(F.col("has_target").isNull(), "NO_SUCH_TARGET").when(F.col("has_vod"), "ALREADY_KNOWN").otherwise("QUEUED")
    return j.withColumn("status", status).drop("has_target", "has_vod")


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null fields of a change of the same key in place of their own."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    return table.join(c, key, "left").select(*[F.coalesce(f"new_{f}", f).alias(f) if f in fields else F.col(f) for f in table.columns])


def observations(claims: DataFrame, keep: list[str]) -> DataFrame:
    """Claims as observations of an entity's timeline; claims without a subject go."""
    named = claims.where(F.trim("subject_entity") != "")
    return named.select(F.lower("subject_entity").alias("entity"), F.coalesce("stance", F.lit("NEUTRAL")).alias("stance"), F.coalesce("polarity", F.lit(0.0)).alias("numeric_value"), F.col("raw_quote").alias("quote"), *keep)


def lexicon_status(state: DataFrame, fresh: Column) -> DataFrame:
    """PROMOTED: a new term from 0.85 confidence on, a known one from 0.80 and 15 occurrences on; else ACTIVE."""
    sure = F.when(fresh, F.col("confidence") >= 0.85).otherwise((F.col("confidence") >= 0.80) & (F.col("occurrences") >= 15))
    return state.withColumn("status", F.when(sure, "PROMOTED").otherwise("ACTIVE"))


def active_lexicon(state: DataFrame) -> DataFrame:
    """intent and its sorted terms, of active and promoted terms with an intent."""
    live = state.where(F.col("status").isin("ACTIVE", "PROMOTED") & (F.col("intent") != "NEUTRAL"))
    return live.groupBy("intent").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def lexicon_listing(state: DataFrame, now: Column, status: str | None = None, half: float = 14.0) -> DataFrame:
    """The terms by falling occurrences, with their confidence as of now."""
    days = (F.unix_timestamp(now) - F.unix_timestamp("last_seen")) / 86400.0
    rows = state if status is None else state.where(F.col("status") == status)
    return rows.withColumn("current_confidence", C.half_life(F.col("confidence"), F.greatest(F.lit(0.0), days), half)).orderBy(F.desc("occurrences"), "term")


def leaderboard(scores: DataFrame, score: str, order: list[Column], most: int) -> DataFrame:
    """The best `most` rows with their rank: a rank among that many rows, none over the whole table."""
    top = scores.orderBy(F.desc(score), *order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), *order)))


def sampling_report(runs: DataFrame, frames: DataFrame, bursts: DataFrame, fps: float = 60.0, frame_sec: float = 0.08) -> DataFrame:
    """What each recorded sampling run has saved, and the share of burst intervals that hold a frame.

    runs: run_id, duration_sec, interval_sec. frames: run_id, t. bursts: run_id, lo, hi.
    """
    from vodlens.operators.temporal import range_join

    taken = frames.groupBy("run_id").agg(F.count(F.lit(1)).alias("analyzed"))
    numbered = bursts.distinct().withColumn("burst", F.struct("lo", "hi"))
    met = range_join(frames, numbered, ["run_id"], "t", "lo", "hi", 60.0).select("run_id", "burst").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("met"))
    every = numbered.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_bursts"))
    j = runs.join(taken, "run_id", "left").join(met, "run_id", "left").join(every, "run_id", "left").fillna(0, ["analyzed", "met", "n_bursts"])
    fixed = F.floor(F.col("duration_sec") / F.col("interval_sec")) + 1
    saved = F.greatest(F.lit(0), fixed - F.col("analyzed"))
    return j.select(
        "run_id", F.floor(F.col("duration_sec") * fps).alias("potential_frames"), fixed.alias("fixed_frames"), "analyzed", saved.alias("frames_saved"),
        F.round(100 * saved / fixed, 2).alias("reduction_pct"), F.round(saved * frame_sec, 2).alias("gpu_sec_saved"), F.when(F.col("n_bursts") == 0, 100.0).otherwise(F.round(100 * F.col("met") / F.col("n_bursts"), 2)).alias("burst_coverage_pct"),
    )
