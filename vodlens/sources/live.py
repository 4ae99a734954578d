"""Live sources: chat as a stream from files, sockets or any Spark source, platform payloads, signed webhooks, settings."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vodlens.sources import chat
from vodlens.sources.tables import ENVELOPE

#: Fixed values of the platform: the events of a webhook that are chat messages.
CHAT_EVENTS = ["chat.message.sent", "App\\Events\\ChatMessageEvent"]


def stream_chat(spark: SparkSession, platform: str, source: str = "text", options: dict[str, str] | None = None, path: str | None = None, **more) -> DataFrame:
    """A platform's raw lines as a stream of chat messages: from a folder of files, a socket, a queue or another source."""
    reader = spark.readStream.format(source).options(**(options or {}))
    lines = reader.load(path) if path else reader.load()
    return chat.normalise(platform, lines.select(F.col("value").cast("string").alias("value")), **more)


def register(platform: str, normaliser) -> None:
    """Adds a platform: a function of a DataFrame of raw texts (value) to chat messages."""
    chat.NORMALISERS[platform] = normaliser


def youtube_api(items: DataFrame, column: str = "value", stream_start_ms: float = 0.0) -> DataFrame:
    """Chat messages from live chat resources of the data API: badges by the author's roles, amounts in micros."""
    schema = (
        "id string, snippet struct<displayMessage:string,publishedAt:string,superChatDetails:struct<amountMicros:string,currency:string,amountDisplayString:string>>, "
        "authorDetails struct<displayName:string,channelId:string,isChatOwner:boolean,isChatModerator:boolean,isChatSponsor:boolean,isVerified:boolean>, _bad string"
    )
    d = items.select(F.col(column).alias("raw"), F.from_json(column, schema, {"columnNameOfCorruptRecord": "_bad"}).alias("d")).where("d is not null and d._bad is null")
    name = F.coalesce("d.authorDetails.displayName", F.lit("Anonymous"))
    roles = [("isChatOwner", "Owner"), ("isChatModerator", "Moderator"), ("isChatSponsor", "Member"), ("isVerified", "Verified")]
    badges = F.array_compact(F.array(*[F.when(F.col(f"d.authorDetails.{role}"), F.lit(badge)) for role, badge in roles]))
    sent = F.unix_micros(F.try_to_timestamp("d.snippet.publishedAt")) / 1e6
    paid = F.col("d.snippet.superChatDetails")
    money = F.when(paid.isNotNull(), F.struct(F.lit("SUPER_CHAT").alias("type"), (F.coalesce(paid["amountMicros"].try_cast("double"), F.lit(0.0)) / 1e6).alias("amount"), F.coalesce(paid["currency"], F.lit("USD")).alias("currency"), F.coalesce(paid["amountDisplayString"], F.lit("")).alias("text")))
    return d.select(
        F.coalesce("d.id", F.sha2("raw", 256)).alias("message_id"), F.greatest(F.lit(0.0), F.coalesce(sent - stream_start_ms / 1000, F.lit(0.0))).alias("timestamp_offset"),
        F.coalesce("d.authorDetails.channelId", F.lower(name)).alias("user_id"), name.alias("author_name"), F.coalesce("d.snippet.displayMessage", F.lit("")).alias("content"),
        F.array().cast(f"array<{chat.EMOTE}>").alias("emotes"), badges.alias("badges"), F.to_json(F.struct(F.lit("YOUTUBE_LIVE").alias("platform"), F.lit("DATA_API_V3").alias("source"), money.alias("monetization"))).alias("metadata"),
    )


def hmac_sha256(secret: str, body: Column) -> Column:
    """The HMAC-SHA256 of a text as lower-case hex, from two nested SHA-256 of built-in functions."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def kick_webhook(requests: DataFrame, secret: str | None = None, body: str = "body", signature: str = "signature", stream_start_ms: float = 0.0) -> DataFrame:
    """Chat messages from webhook requests: of chat events, and, where a secret is set, with a true signature only."""
    good = F.lit(True) if secret is None else F.coalesce(F.trim(signature) == hmac_sha256(secret, F.col(body)), F.lit(False))
    kind = F.coalesce(F.get_json_object(body, "$.event"), F.get_json_object(body, "$.subscription.type"))
    payload = F.coalesce(F.get_json_object(body, "$.data"), F.get_json_object(body, "$.event_data"), F.col(body))
    kept = requests.where(good & kind.isin(*CHAT_EVENTS)).select(payload.alias("value"))
    return chat.kick(kept, stream_start_ms=stream_start_ms)


def read_envelope_table(spark: SparkSession, path: str, stream_id: str | None = None) -> DataFrame:
    """Event envelopes kept as Parquet; the stream filter reaches the scan."""
    rows = spark.read.schema(ENVELOPE).parquet(path)
    return rows if stream_id is None else rows.where(F.col("stream_id") == stream_id)


def settings(defaults: dict, path: str | None = None, prefix: str = "VODLENS_", environment: dict[str, str] | None = None) -> dict:
    """Settings of a JSON file over the defaults, and of the environment over both (PREFIX_NAME, read as the default's type)."""
    out = dict(defaults)
    if path:
        with open(path, encoding="utf-8") as f:
            out |= json.load(f)
    for name, value in (os.environ if environment is None else environment).items():
        key = name.removeprefix(prefix).lower()
        if name.startswith(prefix) and key in out:
            kind = type(out[key])
            out[key] = value.strip().lower() in ("1", "true", "yes", "t") if kind is bool else value if out[key] is None else kind(value)
    return out
