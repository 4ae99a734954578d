"""The fusion matrix: one row per bucket of a stream, from speech, keyframes and chat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vodlens.functions import lexicons as L
from vodlens.operators import chat as chat_ops
from vodlens.operators.temporal import bucket, carry_forward, overlap_buckets, spikes, tumbling_counts


def build_matrix(chat: DataFrame, speech: DataFrame, keyframes: DataFrame, bounds: DataFrame, keys: list[str], width: float = 2.0, lag: float = 4.5) -> DataFrame:
    """Dense slices with chat, speech, the carried-forward screen state, spikes and the agreement index.

    bounds: keys and duration. Chat is shifted by the latency; speech counts where it overlaps a bucket
    strictly; a bucket's last keyframe wins and is carried forward.
    """
    # Counts and mood come from one pass over the chat.
    total, hits = chat_ops.polarity_sums(F.col("content"))
    marked = chat.select(*keys, "timestamp_offset", total.alias("p"), hits.alias("h"))
    dense = spikes(tumbling_counts(marked, bounds, keys, "timestamp_offset", width, lag, p=F.sum("p"), h=F.sum("h")), keys)
    dense = dense.withColumn("sentiment", F.when(F.col("h") > 0, F.col("p") / F.col("h")).otherwise(0.0)).drop("p", "h")
    top = chat_ops.top_tokens(chat, keys, width=width, lag=lag)
    votes = top.groupBy(*keys, "bucket_index").agg(
        F.sum(F.when(F.col("token").isin(*L.AGREEMENT_TOKENS), F.col("n")).otherwise(0)).alias("agree"),
        F.sum(F.when(F.col("token").isin(*L.DISSENT_TOKENS), F.col("n")).otherwise(0)).alias("dissent"),
        F.sort_array(F.collect_list(F.struct("rank", "token", "n"))).alias("dominant_emotes"),
    )
    own = F.col("speaker_label") == "STREAMER"
    pieces = overlap_buckets(speech, "start_sec", "end_sec", width)
    line = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("segment_id", "transcript")))), lambda s: s["transcript"]), " ")
    spoken = pieces.groupBy(*keys, "bucket_index").agg(
        F.sort_array(F.collect_set("speaker_label")).alias("active_speakers"),
        F.max(own).alias("streamer_spoke"),
        F.when(F.max(own), line(own)).alias("streamer_transcript"),
        F.when(F.max(~own), line(~own)).alias("external_audio_transcript"),
    )
    frames = keyframes.withColumn("bucket_index", bucket(F.col("timestamp_sec"), width)).groupBy(*keys, "bucket_index")
    seen = frames.agg(F.max_by(F.struct("scene_type", "screen_summary", "ocr_text_blocks"), "frame_index").alias("frame"))
    at = [*keys, "bucket_index"]
    rows = dense.join(votes, at, "left").join(spoken, at, "left").join(seen, at, "left")
    rows = carry_forward(rows, keys, "bucket_index", ["frame"]).fillna({"sentiment": 0.0, "agree": 0, "dissent": 0})
    spoke = F.coalesce("streamer_spoke", F.lit(False))
    total = F.col("agree") + F.col("dissent")
    agreement = F.when(spoke & (total > 0), (F.col("agree") - F.col("dissent")) / total).when(spoke & (F.col("message_count") > 2), F.col("sentiment"))
    return rows.select(
        *at, "start_sec", (F.col("start_sec") + width).alias("end_sec"), F.coalesce("active_speakers", F.array().cast("array<string>")).alias("active_speakers"), "streamer_transcript", "external_audio_transcript",
        F.coalesce("frame.scene_type", F.lit("UNKNOWN")).alias("active_scene_type"), F.coalesce("frame.screen_summary", F.lit("Unchanged scene")).alias("visual_description"),
        F.coalesce("frame.ocr_text_blocks", F.array().cast("array<string>")).alias("screen_ocr"), F.col("message_count").alias("chat_message_count"), F.col("velocity").alias("chat_velocity_per_sec"),
        "dominant_emotes", F.col("sentiment").alias("chat_sentiment_polarity"), F.col("is_spike").alias("is_spike_moment"), agreement.alias("agreement_score"),
    )


def highlights(slices: DataFrame, before: float = 4.0, after: float = 8.0, edge: float = 0.33) -> DataFrame:
    """Clip bounds and the audience label of each spike."""
    a = F.coalesce("agreement_score", F.lit(0.0))
    label = F.when(F.col("agreement_score").isNull(), "NEUTRAL").when(a >= edge, "ALIGNED").when(a <= -edge, "AUDIENCE_REVOLT").otherwise("DIVIDED")
    return slices.where("is_spike_moment").withColumn("clip_start", F.greatest(F.lit(0.0), F.col("start_sec") - before)).withColumn("clip_end", F.col("end_sec") + after).withColumn("alignment_label", label)


def flat_export(slices: DataFrame) -> DataFrame:
    """The matrix as a flat table: lists joined, tokens as JSON, no null agreement."""
    return slices.withColumns({
        "active_speakers": F.concat_ws(",", "active_speakers"),
        "screen_ocr": F.concat_ws(" | ", "screen_ocr"),
        "dominant_emotes": F.coalesce(F.to_json("dominant_emotes"), F.lit("[]")),
        "agreement_score": F.coalesce("agreement_score", F.lit(0.0)),
    })


def training_triples(slices: DataFrame, edge: float = 0.33) -> DataFrame:
    """One JSON document for each slice in which the streamer spoke or two messages came."""
    a = F.coalesce("agreement_score", F.lit(0.0))
    label = F.when(a >= edge, "ALIGNED").when(a <= -edge, "AUDIENCE_REVOLT").otherwise("DIVIDED")
    kept = slices.where((F.coalesce(F.length("streamer_transcript"), F.lit(0)) > 0) | (F.col("chat_message_count") >= 2))
    return kept.select(F.to_json(F.struct("bucket_index", "visual_description", "streamer_transcript", "chat_message_count", "chat_sentiment_polarity", label.alias("alignment"))).alias("value"))


def chapters(segmented: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Per segment: span, majority scene (ties: first met), mean velocity, and as title its first text on screen, else the scene."""
    rows = segmented.select(*keys, "segment_id", "bucket_index").join(slices, [*keys, "bucket_index"])
    scenes = rows.groupBy(*keys, "segment_id", "active_scene_type").agg(F.count(F.lit(1)).alias("n"), F.min("bucket_index").alias("first"))
    order = Window.partitionBy(*keys, "segment_id").orderBy(F.desc("n"), "first")
    main = scenes.withColumn("r", F.row_number().over(order)).where("r = 1").select(*keys, "segment_id", F.col("active_scene_type").alias("scene_type"))
    spans = rows.groupBy(*keys, "segment_id").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.avg("chat_velocity_per_sec").alias("mean_velocity"), F.min(F.when(F.size("screen_ocr") > 0, F.struct("bucket_index", F.col("screen_ocr")[0].alias("ocr")))).alias("shown"))
    named = spans.join(main, [*keys, "segment_id"])
    return named.withColumn("title", F.coalesce("shown.ocr", F.initcap(F.replace("scene_type", F.lit("_"), F.lit(" "))))).drop("shown")
