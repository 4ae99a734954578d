"""The driver's tables seen as a livestream's: chat, speech, keyframes and event rows.

Each view is a projection (no shuffle, filters and columns reach the scan), with the same rows as SQL
for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = 1704067200  # 2024-01-01, the start of the event stream
STREAMS = 8

TALK = {
    "click": "KEKW that was W",
    "view": "TRUE based take",
    "purchase": "buying with code now",
    "signup": "why is this cap ?",
    "error": "L trash cringe cap",
}
SAID = [" I loved the story", " the gameplay was terrible", " an okay movie", " use NordVPN code LUCKY"]
SCENES = ["GAMEPLAY", "FULLSCREEN_CAM", "REACT_VIDEO", "UNKNOWN"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, its time in seconds since ORIGIN."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - ORIGIN)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.lit(None).cast("string")
    for kind, words in TALK.items():
        content = F.when(F.col("event_type") == kind, words).otherwise(content)
    platform = F.element_at(F.array(*map(F.lit, ["TWITCH", "KICK", "YOUTUBE_LIVE"])), (F.col("user_id") % 3 + 1).cast("int"))
    return events(spark, sf_dir).select(
        (F.col("user_id") % STREAMS).alias("stream_id"), F.col("event_id").alias("message_id"), F.col("t").alias("timestamp_offset"), "user_id",
        F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("author_name"), content.alias("content"), platform.alias("platform"), (F.col("user_id") % 5).alias("channel_id"),
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    start = F.floor(F.col("conv_id") / STREAMS) * 36000.0 + F.col("turn") * 900.0
    more = F.element_at(F.array(*map(F.lit, SAID)), (F.col("turn") % 4 + 1).cast("int"))
    return c.select(
        (F.col("conv_id") % STREAMS).alias("stream_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), start.alias("start_sec"),
        (start + 300.0 + (F.length("text") % 25) * 60.0).alias("end_sec"), F.when(F.col("role") == "user", "STREAMER").otherwise("GUEST").alias("speaker_label"), F.concat("text", more).alias("transcript"),
    )


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'view'")
    scene = F.element_at(F.array(*map(F.lit, SCENES)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        (F.col("user_id") % STREAMS).alias("stream_id"), F.col("event_id").alias("frame_index"), F.col("t").alias("timestamp_sec"), scene.alias("scene_type"),
        F.concat(F.lit("frame "), (F.col("event_id") % 4).cast("string")).alias("screen_summary"), F.when(F.col("event_id") % 7 == 0, F.array(F.lit("Nord VPN deal"))).otherwise(F.array().cast("array<string>")).alias("ocr_text_blocks"),
    )


def bounds(chat_rows: DataFrame) -> DataFrame:
    """stream_id and duration: how far each stream's chat goes."""
    return chat_rows.groupBy("stream_id").agg(F.max("timestamp_offset").alias("duration"))


def _case(column: str, values: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


SQL = f"""
ev AS (SELECT *, epoch_us(ts) / 1e6 - {ORIGIN} AS t FROM events),
chat AS (SELECT user_id % {STREAMS} AS stream_id, event_id AS message_id, t AS timestamp_offset, user_id, 'u' || (user_id % 40) AS author_name,
  {_case('event_type', TALK)} AS content, CASE user_id % 3 WHEN 0 THEN 'TWITCH' WHEN 1 THEN 'KICK' ELSE 'YOUTUBE_LIVE' END AS platform, user_id % 5 AS channel_id FROM ev),
speech AS (SELECT conv_id % {STREAMS} AS stream_id, conv_id * 1000 + turn AS segment_id, s AS start_sec, s + 300.0::DOUBLE + (length(text) % 25) * 60.0::DOUBLE AS end_sec,
  CASE WHEN role = 'user' THEN 'STREAMER' ELSE 'GUEST' END AS speaker_label,
  text || CASE turn % 4 WHEN 0 THEN '{SAID[0]}' WHEN 1 THEN '{SAID[1]}' WHEN 2 THEN '{SAID[2]}' ELSE '{SAID[3]}' END AS transcript
  FROM (SELECT *, (conv_id // {STREAMS}) * 36000.0::DOUBLE + turn * 900.0::DOUBLE AS s FROM conversations)),
keyframes AS (SELECT user_id % {STREAMS} AS stream_id, event_id AS frame_index, t AS timestamp_sec,
  CASE event_id % 4 WHEN 0 THEN '{SCENES[0]}' WHEN 1 THEN '{SCENES[1]}' WHEN 2 THEN '{SCENES[2]}' ELSE '{SCENES[3]}' END AS scene_type,
  'frame ' || (event_id % 4) AS screen_summary, CASE WHEN event_id % 7 = 0 THEN ['Nord VPN deal'] ELSE []::VARCHAR[] END AS ocr_text_blocks FROM ev WHERE event_type = 'view'),
bounds AS (SELECT stream_id, max(timestamp_offset) AS duration FROM chat GROUP BY stream_id)
"""
