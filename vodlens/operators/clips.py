"""Clip operators: anchors, snapping to speech, chat bursts, arcs, copy scores and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.operators.folds import greedy_nms
from vodlens.operators.temporal import range_join


def anchors(highlights: DataFrame, bursts: DataFrame, keys: list[str], least_score: float = 0.65, least_z: float = 2.5) -> DataFrame:
    """Candidate anchors from highlights and chat bursts: keys, anchor_id, peak_sec, score."""
    a = highlights.where(F.col("score") >= least_score).select(*keys, F.concat(F.lit("h"), F.col("item")).alias("anchor_id"), F.col("peak_sec"), "score")
    b = bursts.where(F.col("z_score") >= least_z).select(*keys, F.concat(F.lit("b"), F.col("item")).alias("anchor_id"), F.col("peak_sec"), F.least(F.lit(1.0), 0.5 + F.col("z_score") / 10).alias("score"))
    return a.unionByName(b)


def select_candidates(anchor: DataFrame, keys: list[str], apart: float = 45.0, cap: int | None = None) -> DataFrame:
    return greedy_nms(anchor, keys, "peak_sec", "score", "anchor_id", apart, cap)


def snap(candidates: DataFrame, speech: DataFrame, keys: list[str], item: str, least: float = 15.0, most: float = 60.0) -> DataFrame:
    """Starts move to the first segment start within 3 s, ends to the last segment end within 4 s."""
    c = candidates.withColumns({"s_low": F.col("start_sec") - 3, "s_high": F.col("start_sec") + 3, "e_low": F.col("end_sec") - 4, "e_high": F.col("end_sec") + 4})
    starts = range_join(speech.select(*keys, "segment_id", F.col("start_sec").alias("p_s")), c.select(*keys, item, "s_low", "s_high"), keys, "p_s", "s_low", "s_high", 10.0)
    first = starts.groupBy(*keys, item).agg(F.min_by("p_s", "segment_id").alias("snap_start"))
    ends = range_join(speech.select(*keys, "segment_id", F.col("end_sec").alias("p_e")), c.select(*keys, item, "start_sec", "e_low", "e_high"), keys, "p_e", "e_low", "e_high", 10.0)
    last = ends.where(F.col("p_e") > F.col("start_sec") + least).groupBy(*keys, item).agg(F.max_by("p_e", "segment_id").alias("snap_end"))
    out = candidates.join(first, [*keys, item], "left").join(last, [*keys, item], "left")
    start = F.greatest(F.lit(0.0), F.coalesce("snap_start", "start_sec"))
    out = out.withColumn("clip_start", start)
    return out.withColumn("clip_end", F.col("clip_start") + C.clamp(F.coalesce("snap_end", "end_sec") - F.col("clip_start"), least, most)).drop("snap_start", "snap_end")


def chat_z(in_window: Column, window_sec: Column, total: Column, duration: Column) -> Column:
    rate, base = in_window / window_sec, total / duration
    return C.clamp((rate - base) / F.greatest(F.lit(0.5), 0.5 * base), 0.0, 10.0)


def arc(score: Column, z: Column, agreement: Column | None = None) -> Column:
    """Narrative arc and emotion as a struct."""
    pair = lambda a, e: F.struct(F.lit(a).alias("narrative_arc"), F.lit(e).alias("primary_emotion"))
    out = F.when(z >= 3.5, pair("INSTANT_CLIMAX_REACTION", "HYSTERICAL_LAUGHTER")).when(score >= 0.8, pair("HOOK_BUILDUP_PAYOFF", "HYPE"))
    if agreement is not None:
        out = out.when(agreement < 0.4, pair("HOT_TAKE_AND_DEBATE", "CONTROVERSY"))
    return out.otherwise(pair("HOOK_BUILDUP_PAYOFF", "EXCITEMENT"))


def virality(hook: Column, emotion: Column, z: Column, duration: Column, n_slang: Column, status: Column) -> Column:
    """The composite score of a short, lowered where the audit flags or rejects it."""
    strength = F.least(F.lit(100.0), 70.0 + F.when(F.length(hook) > 0, 15.0).otherwise(0.0) + F.when(emotion.isin("HYSTERICAL_LAUGHTER", "HYPE", "CONTROVERSY"), 10.0).otherwise(0.0))
    resonance = C.clamp(20.0 * z + 30.0, 20.0, 100.0)
    pacing = F.when(duration.between(20.0, 35.0), 95.0).when(duration.between(15.0, 50.0), 80.0).otherwise(65.0)
    meme = F.least(F.lit(100.0), 50.0 + n_slang * 12.0)
    overall = 0.35 * strength + 0.25 * resonance + 0.2 * pacing + 0.2 * meme
    return overall * F.when(status == "FLAGGED", 0.85).when(status == "REJECTED", 0.30).otherwise(1.0)


def layout(scene: Column, has_face: Column) -> Column:
    return F.when(scene == "FULLSCREEN_CAM", "FULL_CONTENT_PAN_SCAN").when(has_face, "STACKED_CAM_CONTENT").otherwise("CAM_PIP")


def facecam(objects: Column) -> Column:
    """The face or person box farthest from the centre that is no larger than 0.85 either way; else the first."""
    face = F.filter(objects, lambda o: F.lower(o["label"]).rlike("face|person|facecam|webcam"))
    small = F.filter(face, lambda o: (o["box"][2] - o["box"][0] <= 0.85) & (o["box"][3] - o["box"][1] <= 0.85))
    away = lambda o: F.pow((o["box"][0] + o["box"][2]) / 2 - 0.5, 2) + F.pow((o["box"][1] + o["box"][3]) / 2 - 0.5, 2)
    best = F.array_max(F.transform(small, away))
    return F.coalesce(F.get(F.filter(small, lambda o: away(o) == best), F.lit(0)), F.get(face, F.lit(0)))


def publish(packages: DataFrame, platforms: list[str], known: tuple[str, ...] = ("YOUTUBE", "TIKTOK", "TWITTER")) -> DataFrame:
    """A row for each package and platform with its status."""
    rows = packages.withColumn("platform", F.explode(F.array(*map(F.lit, platforms))))
    return rows.withColumn("status", F.when(F.upper("platform").isin(*known), "SUCCESS").otherwise("UNSUPPORTED_PLATFORM"))
