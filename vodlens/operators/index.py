"""The chunk index: one table of chunks with the operations of a vector store, and the queries over it.

A chunk has chunk_id, vod_id, streamer_id, content_type, timestamp_sec, text and, where it is embedded,
embedding. Every operation is a table in, a table out; where it is kept is the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.operators import search, store

CHUNK = ["chunk_id", "vod_id", "streamer_id", "content_type", "timestamp_sec", "timestamp_end_sec", "text"]


def insert(chunks: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's chunks replace those of the same id; blank texts are left out, a missing end is five seconds after the start."""
    if {"timestamp_sec", "timestamp_end_sec"} <= set(batch.columns):
        batch = batch.withColumn("timestamp_end_sec", F.coalesce("timestamp_end_sec", F.col("timestamp_sec") + 5.0))
    return store.upsert(chunks, batch.where(F.trim("text") != ""), ["chunk_id"])


def delete_vod(chunks: DataFrame, vod_id: str) -> DataFrame:
    return chunks.where(~F.col("vod_id").eqNullSafe(F.lit(vod_id)))


def get(chunks: DataFrame, ids: list[str]) -> DataFrame:
    return chunks.where(F.col("chunk_id").isin(*ids))


def nearest(chunks: DataFrame, query: list[float], k: int, measure: str = "cosine", digits: int | None = None, **filters) -> DataFrame:
    """The k chunks most similar to the query among those that fit the filters (ties: smaller id)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = C.cosine(F.col("embedding"), q) if measure == "cosine" else C.dot(F.col("embedding"), q)
    found = search.filtered(chunks, **filters).select("chunk_id", (score if digits is None else F.round(score, digits)).alias("score"))
    return search.top(found, k, "score", "chunk_id")


def build(speech: DataFrame, bursts: DataFrame, frames: DataFrame, claims: DataFrame) -> DataFrame:
    """Chunks of one kind each: speech (chunked), chat bursts, screen text and claims.

    speech: vod_id, streamer_id, start_sec, end_sec, text. bursts: vod_id, streamer_id, t, token, times.
    frames: vod_id, streamer_id, timestamp_sec, screen_summary, ocr_text_blocks. claims: vod_id,
    streamer_id, claim_id, t, subject_entity, raw_quote, verdict.
    """
    second = lambda c: F.floor(c).cast("long").cast("string")

    def rows(df: DataFrame, kind: str, tail, start: str, end, text) -> DataFrame:
        chunk = F.concat_ws("_", F.col("vod_id").cast("string"), F.lit(kind), *tail)
        out = df.select(chunk.alias("chunk_id"), "vod_id", "streamer_id", F.lit(kind).alias("content_type"), F.col(start).alias("timestamp_sec"), end.alias("timestamp_end_sec"), F.trim(text).alias("text"))
        return out.where(F.col("text") != "")

    joined = F.array_join("ocr_text_blocks", " ")
    screen = F.when(F.coalesce("screen_summary", F.lit("")) == "", joined).when(joined == "", F.col("screen_summary")).otherwise(F.concat("screen_summary", F.lit(". OCR: "), joined))
    parts = [
        rows(speech, "speech", [second(F.col("start_sec")), second(F.col("end_sec"))], "start_sec", F.col("end_sec"), F.col("text")),
        rows(bursts, "chat", [second(F.col("t"))], "t", F.col("t") + 10, F.concat_ws(" ", F.lit("burst of"), "token", F.lit("x"), F.col("times").cast("string"))),
        rows(frames, "ocr", [second(F.col("timestamp_sec"))], "timestamp_sec", F.col("timestamp_sec") + 3, screen),
        rows(claims, "claim", [F.col("claim_id").cast("string")], "t", F.col("t") + 5, F.concat(F.lit("claim on "), F.col("subject_entity"), F.lit(": "), F.col("raw_quote"), F.lit(" ("), F.col("verdict"), F.lit(")"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relevant_posts(queries: DataFrame, posts: DataFrame, keys: list[str], item: str, query: str, text: str = "post_text") -> DataFrame:
    """Posts on the same screen (keys) whose text holds a query word of over three letters."""
    words = F.filter(F.split(query, " "), lambda w: F.length(w) > 3)
    near = queries.select(*keys, item, words.alias("q_words")).join(posts, keys)
    return near.where(F.exists("q_words", lambda w: F.contains(F.lower(text), F.lower(w)))).drop("q_words")


def with_context(chunks: DataFrame, chat: DataFrame, keys: list[str], around: float = 10.0, most: int = 10) -> DataFrame:
    """chat_context: author, text and offset of up to `most` messages within `around` seconds of each chunk's time, in order.

    chat: keys, message_id, timestamp_offset, author_name, content.
    """
    near = search.chat_context(chunks, chat, keys, "chunk_id", "timestamp_sec", around, most, ["author_name", "content", "timestamp_offset"])
    said = near.select(*keys, "chunk_id", "r", F.struct(F.col("author_name").alias("author"), F.col("content").alias("text"), F.col("timestamp_offset").alias("offset")).alias("m"))
    kept = said.groupBy(*keys, "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "m"))), lambda x: x["m"]).alias("chat_context"))
    none = F.array().cast(kept.schema["chat_context"].dataType)
    return chunks.join(kept, [*keys, "chunk_id"], "left").withColumn("chat_context", F.coalesce("chat_context", none))


def with_embeddings(chunks: DataFrame, dim: int = 128) -> DataFrame:
    """embedding: of each chunk's text."""
    return chunks.join(search.embedded(chunks.select("chunk_id", "text"), "chunk_id", "text", dim), "chunk_id")


def reindexed(chunks: DataFrame, batch: DataFrame, vod_ids: list[str] | None = None) -> DataFrame:
    """The index with all chunks of some recordings (those of the batch) replaced by the batch's."""
    if vod_ids is None:
        gone = batch.select("vod_id").distinct()
        return chunks.join(gone, "vod_id", "left_anti").select(*chunks.columns).unionByName(batch.where(F.trim("text") != ""))
    return chunks.where(~F.col("vod_id").isin(*vod_ids)).unionByName(batch.where(F.col("vod_id").isin(*vod_ids) & (F.trim("text") != "")))
