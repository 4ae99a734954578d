"""Other sources and sinks: event envelopes, rosters, playlists, manifests and partitioned chat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "version string, message_id string, timestamp string, stream_id string, event_type string, trace_id string, parent_id string, producer string, payload string, telemetry string, metadata string"


def read_envelopes(spark: SparkSession, path: str, event_type: str | None = None, stream_id: str | None = None) -> DataFrame:
    """JSON lines of event envelopes; lines that are not JSON go."""
    rows = spark.read.schema(ENVELOPE).option("mode", "DROPMALFORMED").json(path)
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    return rows.where(F.col("stream_id") == stream_id) if stream_id else rows


def write_envelopes(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def to_envelopes(rows: DataFrame, stream: str, event_type: str, item: Column, ts: Column) -> DataFrame:
    """Any rows as envelopes whose payload is their JSON."""
    return rows.select(F.lit("1.0").alias("version"), item.cast("string").alias("message_id"), ts.cast("string").alias("timestamp"), F.col(stream).cast("string").alias("stream_id"), F.lit(event_type).alias("event_type"), F.to_json(F.struct("*")).alias("payload"))


def from_envelopes(envelopes: DataFrame, schema) -> DataFrame:
    """The payloads of envelopes, by their schema."""
    return envelopes.select(F.from_json("payload", schema).alias("r")).select("r.*")


def truthy(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1", "yes", "t")


def list_cell(c: Column) -> Column:
    """A list from a cell: JSON, or separated by ; or ,."""
    parsed = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(parsed, F.filter(F.transform(F.split(c, "[;,]"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Streamer targets from CSV or JSON (a list, or {streamers|targets|roster: [...]})."""
    fields = "streamer_id string, display_name string, channel_urls string, primary_platform string, download_priority string, enabled string, tags string"
    if path.lower().endswith(".csv"):
        raw = spark.read.option("header", True).option("escape", "\"").csv(path)
        names = [f.strip().split(" ")[0] for f in fields.split(",")]
        raw = raw.select(*[(F.col(n) if n in raw.columns else F.lit(None).cast("string")).alias(n) for n in names])
    else:
        one = f"struct<{fields.replace(' string', ':string').replace(', ', ',')}>"
        text = spark.read.text(path, wholetext=True)
        t = F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"roster":'), "value", F.lit("}"))).otherwise(F.col("value"))
        d = text.select(F.from_json(t, f"streamers array<{one}>, targets array<{one}>, roster array<{one}>").alias("d"))
        raw = d.select(F.explode(F.coalesce("d.streamers", "d.targets", "d.roster")).alias("r")).select("r.*")
    return raw.select("streamer_id", "display_name", list_cell(F.col("channel_urls")).alias("channel_urls"), F.coalesce("primary_platform", F.lit("TWITCH")).alias("primary_platform"), F.coalesce(F.col("download_priority").try_cast("int"), F.lit(1)).alias("download_priority"), F.coalesce(truthy(F.col("enabled")), F.lit(True)).alias("enabled"), list_cell(F.col("tags")).alias("tags"))


def platform_of(url: Column) -> Column:
    u = F.lower(url)
    return F.when(F.contains(u, F.lit("twitch")), "TWITCH").when(F.contains(u, F.lit("kick")), "KICK").when(u.rlike("youtube|youtu\\.be"), "YOUTUBE").otherwise("UNKNOWN")


def vod_id(platform: Column, raw: Column) -> Column:
    return F.concat_ws("_", F.lower(platform), F.regexp_replace(raw, "[^A-Za-z0-9_-]", ""))


def publish_date(epoch: Column, day: Column) -> Column:
    """From an epoch number, else from YYYYMMDD."""
    return F.coalesce(F.timestamp_seconds(epoch), F.try_to_timestamp(day, F.lit("yyyyMMdd")))


def discover(playlist: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """Playlist entries (url, id, title, timestamp, upload_date) at or after the cutoff, newest first."""
    platform = platform_of(F.col("url"))
    rows = playlist.select(vod_id(platform, F.col("id")).alias("vod_id"), platform.alias("platform"), "title", publish_date(F.col("timestamp"), F.col("upload_date")).alias("published_at"))
    return rows.where(F.col("published_at").isNull() | (F.col("published_at") >= cutoff)).orderBy(F.desc_nulls_last("published_at"), "vod_id").limit(most)


def read_manifests(spark: SparkSession, pattern: str, field: str, element: str, lines: bool = False) -> DataFrame:
    """stage_outputs.<field> of every manifest, exploded; vod_id defaults to the folder's name. lines: files with a manifest in each line."""
    rows = spark.read.schema(f"vod_id string, stage_outputs struct<{field}:array<{element}>>").option("multiLine", not lines).option("mode", "DROPMALFORMED").json(pattern)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(F.coalesce("vod_id", folder).alias("vod_id"), F.explode(f"stage_outputs.{field}").alias("x")).select("vod_id", "x.*")


def write_chat(chat: DataFrame, path: str, partition: str = "streamer_id") -> None:
    """The columnar chat store: partitioned by streamer, sorted by recording and time within files."""
    chat.repartition(partition, "vod_id").sortWithinPartitions("vod_id", "timestamp_ms").write.mode("append").partitionBy(partition).parquet(path)


def write_speech(segments: DataFrame, path: str, partition: str = "streamer_id") -> None:
    """The columnar speech store: a batch is one insert; partitioned by streamer, sorted by recording and start."""
    segments.repartition(partition, "vod_id").sortWithinPartitions("vod_id", "start_ms").write.mode("append").partitionBy(partition).parquet(path)


def verify_checksums(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """name, sha256 and whether each file of the folder fits the expected digest (name, sha256)."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    return files.join(expected, "name").select("name", "sha256", (F.col("actual") == F.lower("sha256")).alias("is_valid"))
