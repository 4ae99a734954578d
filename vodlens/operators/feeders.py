"""Feeders between modules: what is harvested goes on to voiceprints, chatter profiles, the lexicon and sponsor audits.

Each takes tables and a state table that it folds them into; fan() hands one harvested batch to several,
and one that fails does not keep the others from theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.operators import chat as chat_ops
from vodlens.operators import enrolment, store
from vodlens.sources.state import StateTable


def seed_voiceprints(targets: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """streamer_id, sample_count and centroid: the roster's embeddings first, then later samples (streamer_id, sample_id, embedding) in order."""
    own = targets.where(F.size("voiceprint_embedding") > 0).select("streamer_id", F.lit(-1).cast("long").alias("sample_id"), F.col("voiceprint_embedding").cast("array<double>").alias("embedding"))
    if samples is not None:
        own = own.unionByName(samples.select("streamer_id", F.col("sample_id").cast("long"), F.col("embedding").cast("array<double>")))
    return enrolment.enrol(own, "streamer_id", ["sample_id"], "embedding")


def chatter_safety(table: StateTable, chat: DataFrame, streamer_id: str) -> int:
    """Folds a recording's chat into the kept messages of chatters (its vod is the streamer's id, as harvested chat has no other); one that is there stays once."""
    rows = chat.select("message_id", "user_id", "author_name", "content", F.lit(streamer_id).alias("vod_id")).dropDuplicates(["message_id"])
    return table.update(lambda now: rows if now is None else now.unionByName(store.unknown(rows, now, "message_id")), f"chat of {streamer_id}")


def chatter_profiles(table: StateTable) -> DataFrame:
    """The profiles of all chatters so far."""
    return chat_ops.profiles(table.read())


def fan(batch: DataFrame, feeders: dict[str, Callable[[DataFrame], object]]) -> dict[str, str | None]:
    """Hands a batch to every feeder; the error of each that failed, None for the others."""
    out: dict[str, str | None] = {}
    for name, feed in feeders.items():
        try:
            feed(batch)
            out[name] = None
        except Exception as e:  # one feeder's failure is no other's
            out[name] = f"{type(e).__name__}: {e}"
    return out
