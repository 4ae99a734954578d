"""The live side around the streams: rolling buffers, ingest velocity, bounded queues, replay, status, alerts, restarts."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vodlens.operators import costream
from vodlens.plans.session import ship_package


def rolling_buffer(events: DataFrame, key: str, ts: str, item: str, window_sec: float) -> DataFrame:
    """After each batch, the items of each key (ts in seconds) that are at most two windows older than its newest."""
    ship_package(events.sparkSession)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        held = sorted([*held, *pd.concat(list(batches))[[ts, item]].itertuples(index=False, name=None)])
        held = [h for h in held if h[0] >= held[-1][0] - 2 * window_sec]
        state.update(tuple(map(list, zip(*held))))
        yield pd.DataFrame([(group[0], t, i) for t, i in held], columns=[key, ts, item])

    out = f"{key} long, {ts} double, {item} long"
    return events.select(key, F.col(ts).cast("double").alias(ts), item).groupBy(key).applyInPandasWithState(step, out, "times array<double>, items array<long>", "update", GroupStateTimeout.NoTimeout)


def bounded_queue(events: DataFrame, key: str, ts: str, item: str, size: int, drop: str = "oldest") -> DataFrame:
    """What a queue of `size` items per key holds after each batch; when it is full the oldest or the newest go."""
    if drop not in ("oldest", "newest"):
        raise ValueError(f"drop is oldest or newest, not {drop}")
    ship_package(events.sparkSession)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        fresh = sorted(pd.concat(list(batches))[[ts, item]].itertuples(index=False, name=None))
        held = sorted([*held, *fresh])[-size:] if drop == "oldest" else [*held, *fresh][:size]
        state.update(tuple(map(list, zip(*held))))
        yield pd.DataFrame([(group[0], t, i) for t, i in held], columns=[key, ts, item])

    out = f"{key} long, {ts} double, {item} long"
    return events.select(key, F.col(ts).cast("double").alias(ts), item).groupBy(key).applyInPandasWithState(step, out, "times array<double>, items array<long>", "update", GroupStateTimeout.NoTimeout)


def ingest_velocity(events: DataFrame, keys: list[str], size: str = "10 seconds", hop: str = "1 second", seconds: float = 10.0) -> DataFrame:
    """Messages a second over windows of the time at which they came in, whatever their own time says."""
    arrived = events.withColumn("ingested", F.current_timestamp()).withWatermark("ingested", size)
    per = arrived.groupBy(*keys, F.window("ingested", size, hop).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select(*keys, "w.start", "w.end", "n", (F.col("n") / max(1.0, seconds)).alias("velocity"))


def replay(table: DataFrame, order: list[str], count: int = 50, event_types: list[str] | None = None) -> DataFrame:
    """The last `count` events, of which those of the given types (all, or *)."""
    last = table.orderBy(*[F.desc(c) for c in order]).limit(count)
    return last if not event_types or "*" in event_types else last.where(F.col("event_type").isin(*event_types))


def status(events: DataFrame, keys: list[str], ts: str, now: float | None = None, window_sec: float = 10.0) -> DataFrame:
    """Per key: messages, platforms, last time, velocity of the last window and whether it still speaks."""
    last = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("platform").alias("n_platforms"), F.max(ts).alias("last_ts"))
    marked = events.select(*keys, ts).join(last.select(*keys, "last_ts"), keys).where(F.col(ts) > F.col("last_ts") - window_sec)
    recent = marked.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(max(1.0, window_sec))).alias("velocity"))
    out = last.join(recent, keys)
    if now is not None:
        return out.withColumn("is_live", F.lit(float(now)) - F.col("last_ts") <= 60 * window_sec)
    newest = events.agg(F.max(ts).alias("newest"))  # one row
    return out.crossJoin(F.broadcast(newest)).withColumn("is_live", F.col("newest") - F.col("last_ts") <= 60 * window_sec).drop("newest")


def last_rows(rows: DataFrame, keys: list[str], order: list[str], most: int = 500) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("l_rank", F.row_number().over(w)).where(F.col("l_rank") <= most).drop("l_rank")


def audience_alerts(aligned: DataFrame, keys: list[str], most: int = 500, width: float = 10.0) -> DataFrame:
    """Points at which the platforms' moods diverge, among the last messages of each key."""
    recent = last_rows(aligned, keys, ["unified_ts", "message_id"], most)
    return costream.sentiment_timeline(recent, keys, width=width).where("divergence_detected")


def periodic_alerts(history: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], keys: list[str], most: int = 500, width: float = 10.0) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: after each batch, the alerts of the last messages in the kept history."""

    def body(batch: DataFrame, epoch: int) -> None:
        sink(audience_alerts(history(), keys, most, width), epoch)

    return body


def backoff(attempt: int, base: float = 2.0, most: float = 60.0, jitter: float = 0.5, draw: Callable[[], float] = random.random) -> float:
    """Seconds before an attempt (from 1 on): doubled each time up to `most`, and up to half of that more by chance."""
    wait = min(most, base * 2 ** (attempt - 1))
    return wait * (1 + jitter * draw())


def supervised(start: Callable[[], StreamingQuery], attempts: int = 10, sleep: Callable[[float], None] = time.sleep, **waits) -> int:
    """Runs a query to its end, starting it anew after failures; returns how many times it was started."""
    for attempt in range(1, attempts + 1):
        try:
            start().awaitTermination()
            return attempt
        except Exception:
            if attempt == attempts:
                raise
            sleep(backoff(attempt, **waits))
    return attempts
