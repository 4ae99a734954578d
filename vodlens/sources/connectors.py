"""Live connectors: chat over sockets as a Spark stream that can be replayed.

A socket gives every line once, while Spark asks for the same offsets again after a failure. So receiver
threads beside the driver's stream reader write the lines of each channel to a log in storage that all
executors share, and an offset is how many lines of a channel are in the log: nothing counts before it
is stored. Tasks read ranges of lines from the log, some rows each, as often as Spark asks; a new start
of the query goes on where the log ends.

The log of a channel is a folder of immutable Parquet segments named by their first line and number of
lines; they appear under their names when they are complete. One stream writes to a log at a time; any
number read it. `spark.read.format("livechat")` reads a log, `df.write.format("livechat")` puts a
recording (channel, place, received_at, value) into one, with places that go on without a gap.

After a broken connection a receiver comes back with growing pauses, says hello again, throws an
unfinished line away and leaves out messages whose id it has logged lately: a server that repeats
its latest messages doubles none. What a server without a history sends while nobody listens is lost.

Options: log (a folder, as a path or URI that pyarrow's file systems open), channels (`name=host:port`,
separated by commas; empty: only what the log holds), protocol (irc or lines), nick, token, tls,
flushLines and flushSeconds (what a segment holds at most), rowsPerPartition, keep (`all`, or `unread`:
segments go when a batch that covers them is committed).
"""

from __future__ import annotations

import json
import re
import socket
import ssl
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from vodlens.plans.session import ship_package

SCHEMA = "channel string, place long, received_at timestamp, value string"
COLUMNS = ["channel", "place", "received_at", "value"]
SEGMENT = re.compile(r"(\d{20})-(\d+)\.parquet$")
PAUSE, LONGEST_PAUSE, REMEMBERED = 0.2, 30.0, 10_000


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class LineLog:
    """The stored lines of one channel."""

    def __init__(self, uri: str, channel: str):
        if not re.fullmatch(r"[\w.#-]+", channel):
            raise ValueError(f"not a channel name: {channel!r}")
        self.channel = channel
        self.fs, root = opened(uri)
        self.path = f"{root.rstrip('/')}/{channel}"

    def segments(self) -> list[tuple[int, int, str]]:
        """First line, number of lines and path of each segment, in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted((int(m[1]), int(m[2]), f.path) for f in found if (m := SEGMENT.search(f.path)))

    def size(self) -> int:
        """How many lines the log has had; segments count up to the first gap after the oldest one that is left."""
        parts = self.segments()
        end = parts[0][0] if parts else 0
        for first, count, _ in parts:
            if first != end:
                break
            end = first + count
        return end

    def append(self, first: int, rows: list[tuple[datetime, str]]) -> None:
        """One segment, complete at once."""
        table = pa.table({"place": pa.array(range(first, first + len(rows)), pa.int64()), "received_at": pa.array([r[0] for r in rows], pa.timestamp("us", "UTC")), "value": pa.array([r[1] for r in rows], pa.string())})
        self.fs.create_dir(self.path, recursive=True)
        temporary = f"{self.path}/_{uuid.uuid4().hex}"
        pq.write_table(table, temporary, filesystem=self.fs)
        self.fs.move(temporary, f"{self.path}/{first:020d}-{len(rows)}.parquet")

    def read(self, first: int, last: int) -> Iterator[pa.RecordBatch]:
        """Lines first..last-1."""
        for start, count, path in self.segments():
            if start < last and start + count > first:
                rows = pq.read_table(path, filesystem=self.fs)
                rows = rows.filter(pc.and_(pc.greater_equal(rows["place"], first), pc.less(rows["place"], last)))
                yield from rows.add_column(0, "channel", pa.array([self.channel] * len(rows), pa.string())).select(COLUMNS).to_batches()

    def drop(self, before: int) -> None:
        """Segments that end at or before a line go; the newest stays, it holds the count."""
        for first, count, path in self.segments()[:-1]:
            if first + count <= before:
                self.fs.delete_file(path)


class Lines:
    """Plain lines: nothing is said, every line is a message."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def hello(self, channel: str) -> bytes:
        return b""

    def answer(self, line: str) -> bytes | None:
        """What goes back for a line that is no message."""
        return None

    def key(self, line: str) -> str | None:
        return None


class Irc(Lines):
    """IRC with message tags: capabilities, name, channel; PING is answered; the id tag tells messages apart."""

    def hello(self, channel: str) -> bytes:
        nick = self.options.get("nick") or f"justinfan{uuid.uuid4().int % 90_000 + 10_000}"
        lines = ["CAP REQ :twitch.tv/tags twitch.tv/commands", f"PASS {self.options.get('token') or 'none'}", f"NICK {nick}", f"JOIN #{channel.lstrip('#')}"]
        return "".join(f"{x}\r\n" for x in lines).encode()

    def answer(self, line: str) -> bytes | None:
        return f"PONG {line[4:].strip() or ':server'}\r\n".encode() if line.startswith("PING") else None

    def key(self, line: str) -> str | None:
        found = re.match(r"@(?:[^ ]*;)?id=([^; ]+)", line)
        return found[1] if found else None


PROTOCOLS = {"lines": Lines, "irc": Irc}


class Receiver(threading.Thread):
    """Keeps one channel's connection and writes its lines to the log."""

    def __init__(self, log: LineLog, host: str, port: int, protocol: Lines, flush_lines: int = 1_000, flush_seconds: float = 1.0, tls: bool = False):
        super().__init__(daemon=True, name=f"livechat-{log.channel}")
        self.log, self.address, self.protocol, self.tls = log, (host, port), protocol, tls
        self.flush_lines, self.flush_seconds = flush_lines, flush_seconds
        self.ended = threading.Event()
        self.held: list[tuple[datetime, str]] = []
        self.since = time.monotonic()
        self.at = log.size()
        self.seen: OrderedDict[str, None] = OrderedDict()
        for batch in log.read(max(0, self.at - REMEMBERED), self.at):
            for line in batch.column(3).to_pylist():
                self.remember(protocol.key(line))

    def remember(self, key: str | None) -> bool:
        """Whether a message with that id is new."""
        if key is None:
            return True
        if key in self.seen:
            return False
        self.seen[key] = None
        if len(self.seen) > REMEMBERED:
            self.seen.popitem(last=False)
        return True

    def flush(self) -> None:
        if self.held:
            self.log.append(self.at, self.held)
            self.at += len(self.held)
            self.held = []
        self.since = time.monotonic()

    def tell(self, state: str, tries: int, error: str | None = None) -> None:
        """The channel's state, beside its segments."""
        self.log.fs.create_dir(self.log.path, recursive=True)
        with self.log.fs.open_output_stream(f"{self.log.path}/state.json") as f:
            f.write(json.dumps({"channel": self.log.channel, "state": state, "tries": tries, "error": error, "lines": self.at}).encode())

    def run(self) -> None:
        pause, tries = PAUSE, 0
        while not self.ended.is_set():
            tries += 1
            error = None
            try:
                with socket.create_connection(self.address, timeout=10) as plain:
                    with ssl.create_default_context().wrap_socket(plain, server_hostname=self.address[0]) if self.tls else plain as s:
                        s.sendall(self.protocol.hello(self.log.channel))
                        s.settimeout(max(0.05, self.flush_seconds / 2))
                        self.tell("CONNECTED", tries)
                        if self.listen(s):
                            pause = PAUSE
            except OSError as e:
                error = str(e)
            self.flush()
            self.tell("ENDED" if self.ended.is_set() else "WAITING", tries, error)
            self.ended.wait(pause)
            pause = min(LONGEST_PAUSE, pause * 2)

    def listen(self, s: socket.socket) -> bool:
        """Reads until the other side closes; whether a line came."""
        rest, came = b"", False
        while not self.ended.is_set():
            try:
                more = s.recv(65_536)
                if not more:
                    return came
            except TimeoutError:
                more = b""
            *lines, rest = (rest + more).split(b"\n")
            for raw in lines:
                line = raw.decode("utf-8", "replace").rstrip("\r")
                back = self.protocol.answer(line)
                if back is not None:
                    s.sendall(back)
                elif line and self.remember(self.protocol.key(line)):
                    self.held.append((datetime.now(timezone.utc), line))
                    came = True
            if len(self.held) >= self.flush_lines or time.monotonic() - self.since >= self.flush_seconds:
                self.flush()
        return came


class Range(InputPartition):
    """Some lines of one channel."""

    def __init__(self, channel: str, first: int, last: int):
        self.channel, self.first, self.last = channel, first, last


def ranges(channel: str, first: int, last: int, rows: int) -> list[Range]:
    return [Range(channel, at, min(at + rows, last)) for at in range(first, last, rows)]


class LogReader(DataSourceReader):
    """A log as a table."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def channels(self) -> list[str]:
        files, root = opened(self.options["log"])
        return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory)

    def partitions(self) -> list[Range]:
        rows, out = int(self.options.get("rowsperpartition", 50_000)), []
        for channel in self.channels():
            log = LineLog(self.options["log"], channel)
            parts = log.segments()
            out += ranges(channel, parts[0][0], log.size(), rows) if parts else []
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # None: Spark's way to read a source without partitions
            yield from LineLog(self.options["log"], partition.channel).read(partition.first, partition.last)


class LiveReader(DataSourceStreamReader):
    """The same log while it grows. Receivers start with the first offset that Spark asks for."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.receivers: list[Receiver] | None = None

    def addresses(self) -> dict[str, tuple[str, int]]:
        found = [re.fullmatch(r"([^=]+)=(.+):(\d+)", x.strip()) for x in self.options.get("channels", "").split(",") if x.strip()]
        if None in found:
            raise ValueError("channels: name=host:port, separated by commas")
        return {m[1]: (m[2], int(m[3])) for m in found}

    def start(self) -> None:
        if self.receivers is not None:
            return
        o = self.options
        protocol = PROTOCOLS[o.get("protocol", "irc")](o)
        self.receivers = []
        for channel, (host, port) in self.addresses().items():
            r = Receiver(LineLog(o["log"], channel), host, port, protocol, int(o.get("flushlines", 1_000)), float(o.get("flushseconds", 1.0)), o.get("tls", "false") == "true")
            r.start()
            self.receivers.append(r)

    def sizes(self) -> dict[str, int]:
        names = {*self.addresses(), *LogReader(self.options).channels()}
        return {c: LineLog(self.options["log"], c).size() for c in sorted(names)}

    def initialOffset(self) -> dict[str, int]:
        return dict.fromkeys(self.sizes(), 0)

    def latestOffset(self) -> dict[str, int]:
        self.start()
        return self.sizes()

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        rows = int(self.options.get("rowsperpartition", 50_000))
        return [p for channel, last in end.items() for p in ranges(channel, start.get(channel, 0), last, rows)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # None: Spark's way to read a source without partitions
            yield from LineLog(self.options["log"], partition.channel).read(partition.first, partition.last)

    def commit(self, end: dict[str, int]) -> None:
        if self.options.get("keep", "all") == "unread":
            for channel, last in end.items():
                LineLog(self.options["log"], channel).drop(last)

    def stop(self) -> None:
        for r in self.receivers or []:
            r.ended.set()
        for r in self.receivers or []:
            r.join(timeout=15)


class LogWriter(DataSourceArrowWriter):
    """Puts a recording into a log: a segment for each run of places in a task. Rows come sorted by channel and place."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        most, held = int(self.options.get("flushlines", 50_000)), []

        def put() -> None:
            if held:
                LineLog(self.options["log"], held[0][0]).append(held[0][1], [(r[2], r[3]) for r in held])
                held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS)):
                if held and (row[0] != held[-1][0] or row[1] != held[-1][1] + 1 or len(held) >= most):
                    put()
                held.append(row)
        put()
        return WriterCommitMessage()


class LiveChat(DataSource):
    """The format `livechat`."""

    @classmethod
    def name(cls) -> str:
        return "livechat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(LiveChat)


def live_lines(spark: SparkSession, log: str, channels: dict[str, tuple[str, int]] | None = None, **options) -> DataFrame:
    """The lines of some channels as a stream: channel, place, received_at, value."""
    register(spark)
    listed = ",".join(f"{c}={host}:{port}" for c, (host, port) in (channels or {}).items())
    return spark.readStream.format("livechat").options(log=log, channels=listed, **options).load()


def record(lines: DataFrame, log: str, keys: list[str] | None = None, **options) -> None:
    """Puts lines (channel, place, received_at, value) into a log, range-sorted so that tasks hold runs."""
    register(lines.sparkSession)
    order = keys or ["channel", "place"]
    lines.select(*COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order).write.format("livechat").mode("append").options(log=log, **options).save()


def channel_states(spark: SparkSession, log: str) -> DataFrame:
    """channel, state, tries, error and lines of every channel that a receiver has worked on."""
    return spark.read.schema("channel string, state string, tries int, error string, lines long").json(f"{log}/*/state.json")
