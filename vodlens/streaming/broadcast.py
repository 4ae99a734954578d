"""The live broadcaster: clients that come and go, their topics and their bounded queues, as keyed state of a stream.

One stream carries all that happens on a channel: events, and what clients do (join, take, leave). A
channel's clients are dealt over shards by a hash, an event goes to each shard once, and a shard's
state holds its clients, each with topics, the time it was last heard of and a list of what waits for
it. So the work of a channel with very many clients is spread, and an event is copied per shard, not
per client. Rows of a batch are worked on in order of time and number.

join registers a client, or changes the topics of one that is there (its queue stays); with a replay
count it begins with those of the channel's latest events that fit its topics. An event waits in the
queue of every client whose topics fit; a full queue drops it. take hands out up to `count` waiting
events, oldest first. Clients that have not been heard of for `idle` go by a timer, by event time.

Rows out: QUEUED and DROPPED (event, client), DELIVERED (in order of `place`), JOINED, LEFT and EXPIRED (place: how
much was still waiting). A take or leave of an unknown client gives nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from vodlens.plans.session import ship_package

OPS = ["channel", "at", "seq", "op", "client", "topics", "event_type", "item", "count"]
OUT = "channel string, client string, at timestamp, what string, item long, place long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLIENT = "topics array<string>, seen long, items array<long>"
RECENT = "item long, event_type string"
WHAT = ["QUEUED", "DROPPED", "DELIVERED", "JOINED", "LEFT"]
QUEUED, DROPPED, DELIVERED, JOINED, LEFT = range(5)
#: Rows that a task holds before it gives them out.
OUT_ROWS = 50_000


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within use the store that this kind of state needs."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def fits(topics: list[str], event_type: str) -> bool:
    return "*" in topics or event_type in topics


class Told:
    """Rows to give out: runs of clients that are told the same. A frame holds at most OUT_ROWS; its columns are made run by run, not row by row."""

    def __init__(self, channel: str | None):
        self.channel = channel
        self.names: list[str] = []
        self.codes: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.rows, self.runs, self.who = 0, [], []

    def code(self, client: str) -> int:
        """The client's number in this batch."""
        if client not in self.codes:
            self.codes[client] = len(self.names)
            self.names.append(client)
        return self.codes[client]

    def add(self, at: int, who: np.ndarray, what: int, item=None, place=None) -> Iterator[pd.DataFrame]:
        for k in range(0, len(who), OUT_ROWS):
            some = who[k : k + OUT_ROWS]
            if self.rows + len(some) > OUT_ROWS:
                yield self.frame()
            self.rows += len(some)
            self.who.append(some)
            self.runs.append((at, what, item, place, len(some)))

    def one(self, at: int, client: str, what: int, item=None, place=None) -> Iterator[pd.DataFrame]:
        return self.add(at, np.array([self.code(client)], np.int32), what, item, place)

    def frame(self) -> pd.DataFrame:
        at, what, item, place, n = zip(*self.runs)
        each = lambda c: np.repeat(pd.Series(c, dtype="Int64").array, n)
        text = lambda values, k: pd.arrays.ArrowExtensionArray(pa.array(values, pa.string()).take(pa.array(k)))
        out = {"channel": text([self.channel], np.zeros(self.rows, np.int32)), "client": text(self.names, np.concatenate(self.who)), "at": np.repeat(np.array(at, "datetime64[ns]"), n)}
        out |= {"what": text(WHAT, np.repeat(np.array(what, np.int32), n)), "item": each(item), "place": each(place)}
        self.clear()
        return pd.DataFrame(out)


class Fitting:
    """The clients whose topics an event type fits: those with room in their queues, and those without."""

    def __init__(self):
        self.open: dict[str, None] = {}
        self.full: dict[str, None] = {}
        self.codes: np.ndarray | None = None

    def put(self, client: str, wanted: bool, room: bool) -> None:
        """Whether the client is among them, and where."""
        to, other = (self.open, self.full) if room else (self.full, self.open)
        if wanted and client in to or not wanted and client not in to and client not in other:
            return
        self.open.pop(client, None)
        self.full.pop(client, None)
        if wanted:
            to[client] = None
        self.codes = None

    def fill(self, client: str) -> None:
        """The client's queue has no more room."""
        if client in self.open:
            del self.open[client]
            self.full[client] = None
            self.codes = None

    def full_codes(self, told: Told) -> np.ndarray:
        if self.codes is None:
            self.codes = np.fromiter(map(told.codes.__getitem__, self.full), np.int32, len(self.full))
        return self.codes


class Broadcaster(StatefulProcessor):
    """The clients of one shard of a channel."""

    def __init__(self, capacity: int, replay: int, idle_ms: int):
        self.capacity, self.replay, self.idle_ms = capacity, replay, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clients = handle.getMapState("clients", "client string", CLIENT)
        self.recent = handle.getListState("recent", RECENT)

    def due(self, held: dict[str, list]) -> None:
        """One timer: when the client that has been silent longest will have to go."""
        want = min((c[1] for c in held.values()), default=None)
        timers = list(self.handle.listTimers())
        for t in timers:
            if want is None or t != want + self.idle_ms:
                self.handle.deleteTimer(t)
        if want is not None and want + self.idle_ms not in timers:
            self.handle.registerTimer(want + self.idle_ms)

    def read(self) -> dict[str, list]:
        return {k[0]: [list(v[0] or []), v[1], list(v[2] or [])] for k, v in self.clients.iterator()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.read()
        recent = deque((tuple(r) for r in self.recent.get()), maxlen=self.replay)
        changed: set[str] = set()
        told = Told(key[0])
        for who in held:
            told.code(who)
        fitting: dict[str, Fitting] = {}  # by event type

        def place(client: str) -> None:
            """The client's topics, its queue or whether it is there have changed."""
            c = held.get(client)
            for kind, f in fitting.items():
                f.put(client, c is not None and fits(c[0], kind), c is not None and len(c[2]) < self.capacity)

        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        if batch["at"].isna().any():
            raise ValueError("an operation has no time")
        times = batch["at"].to_numpy("datetime64[ns]").astype(np.int64).tolist()
        for at, op, client, topics, event_type, item, count in zip(times, *[batch[c] for c in ("op", "client", "topics", "event_type", "item", "count")]):
            ms = at // 1_000_000
            if op == "event":
                item = int(item)
                recent.append((item, event_type))
                f = fitting.get(event_type)
                if f is None:
                    f = fitting[event_type] = Fitting()
                    for who, c in held.items():
                        f.put(who, fits(c[0], event_type), len(c[2]) < self.capacity)
                yield from told.add(at, f.full_codes(told), DROPPED, item)
                if f.open:
                    queued = list(f.open)
                    changed.update(queued)
                    for who in queued:
                        items = held[who][2]
                        items.append(item)
                        if len(items) >= self.capacity:
                            for g in fitting.values():
                                g.fill(who)
                    yield from told.add(at, np.array([told.codes[who] for who in queued], np.int32), QUEUED, item)
            elif op == "join":
                wanted = list(topics) if topics is not None and len(topics) else ["*"]
                fresh = client not in held
                c = held.setdefault(client, [wanted, ms, []])
                moved = fresh or c[0] != wanted
                c[0], c[1] = wanted, max(c[1], ms)
                changed.add(client)
                if fresh:
                    yield from told.one(at, client, JOINED)
                    again = [i for i, kind in (list(recent)[-int(count) :] if count and count > 0 else []) if fits(wanted, kind)]
                    for i in again[: self.capacity]:
                        c[2].append(i)
                        yield from told.one(at, client, QUEUED, i)
                if moved:
                    place(client)
            elif client in held and op == "take":
                c = held[client]
                n = len(c[2]) if pd.isna(count) else max(0, int(count))
                for k, i in enumerate(c[2][:n]):
                    yield from told.one(at, client, DELIVERED, i, k)
                c[2], c[1] = c[2][n:], max(c[1], ms)
                changed.add(client)
                place(client)
            elif client in held and op == "leave":
                yield from told.one(at, client, LEFT, None, len(held.pop(client)[2]))
                changed.discard(client)
                self.clients.removeKey((client,))
                place(client)
        for who in changed:
            topics, seen, items = held[who]
            self.clients.updateValue((who,), (topics, seen, items))
        self.recent.put(list(recent)) if recent else self.recent.clear()
        self.due(held)
        if told.rows:
            yield told.frame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held, out = expiredTimerInfo.getExpiryTimeInMs(), self.read(), []
        for who, (_, seen, items) in list(held.items()):
            if seen + self.idle_ms <= now:
                out.append((key[0], who, datetime.fromtimestamp(now / 1000, timezone.utc), "EXPIRED", None, len(items)))
                self.clients.removeKey((who,))
                del held[who]
        want = min((c[1] for c in held.values()), default=None)
        if want is not None:
            self.handle.registerTimer(want + self.idle_ms)
        yield self.frame(out)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(rows, columns=["channel", "client", "at", "what", "item", "place"])
        return df.astype({"item": "Int64", "place": "Int64"}).assign(at=pd.to_datetime(df["at"], utc=True).dt.tz_localize(None))


def broadcast(ops: DataFrame, shards: int = 8, capacity: int = 500, replay: int = 1_000, idle_sec: float = 3_600.0, delay: str = "10 minutes") -> DataFrame:
    """What becomes of the operations (columns OPS; at is a timestamp). Start the stream within state_store()."""
    ship_package(ops.sparkSession)
    shard = F.when(F.col("op") == "event", F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("client"), F.lit(shards)).cast("int")))
    dealt = ops.select(*OPS).withWatermark("at", delay).withColumn("shard", F.explode(shard))
    return dealt.groupBy("channel", "shard").transformWithStateInPandas(Broadcaster(capacity, replay, int(idle_sec * 1000)), OUT, "Append", "EventTime")
