"""Live connectors against a local server that breaks off, and logs that are read again."""

import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from vodlens.sources import chat, connectors


class Server(threading.Thread):
    """An IRC server with a history: after each break it repeats the last messages and ends a line that it had begun."""

    def __init__(self, lines, breaks, repeat=3):
        super().__init__(daemon=True)
        self.lines, self.breaks, self.repeat = lines, breaks, repeat
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.port = self.socket.getsockname()[1]
        self.heard = b""
        self.pongs = 0

    def run(self):
        at = 0
        for stop in [*self.breaks, len(self.lines)]:
            client, _ = self.socket.accept()
            client.settimeout(5)
            while b"JOIN" not in self.heard.rpartition(b"CAP")[2]:
                self.heard += client.recv(4096)
            client.sendall(b"PING :are you there\r\n")
            answer = b""
            while not answer.endswith(b"\n"):
                answer += client.recv(4096)
            self.pongs += answer == b"PONG :are you there\r\n"
            for line in self.lines[max(0, at - self.repeat) : stop]:
                client.sendall(line.encode() + b"\r\n")
            if stop < len(self.lines):
                client.sendall(self.lines[stop][:20].encode())  # cut off within a line
                client.close()
            at = stop
        self.client = client  # stays open


def privmsg(channel, k):
    return f"@id={channel}-{k};display-name=Ann :ann!ann@ann PRIVMSG #{channel} :message {k} é"


def drained(stream, folder, name, wanted, spark, seconds=60):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").queryName(name).trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + seconds
        while time.time() < end and query.exception() is None:
            rows = sum(p["numInputRows"] for p in query.recentProgress)
            if rows >= wanted:
                break
            time.sleep(0.2)
        assert query.exception() is None, query.exception()
    finally:
        query.stop()


def test_socket_breaks_and_query_restarts(spark, tmp_path):
    sent = {c: [privmsg(c, k) for k in range(n)] for c, n in (("red", 400), ("blue", 250))}
    servers = {c: Server(lines, [len(lines) // 3, len(lines) // 2]) for c, lines in sent.items()}
    for s in servers.values():
        s.start()
    log = f"file://{tmp_path}/log"
    lines = lambda: connectors.live_lines(spark, log, {c: ("127.0.0.1", s.port) for c, s in servers.items()}, flushLines="40", flushSeconds="0.2", rowsPerPartition="64")
    drained(lines(), tmp_path, "first", 200, spark)
    # What came after the last batch of the first run is in the log; the second run has nobody to connect to and reads the rest.
    connectors_left = spark.read.format("livechat").option("log", log).load().count()
    rest = {c: len(sent[c]) for c in sent}
    if connectors_left < sum(rest.values()):
        for s in servers.values():
            s.join(timeout=20)
    spark_rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert spark_rows >= 200
    drained(connectors.live_lines(spark, log, rowsPerPartition="64"), tmp_path, "second", connectors_left - spark_rows, spark, 30)
    out = spark.read.parquet(f"{tmp_path}/out")
    stored = spark.read.format("livechat").option("log", log).load()
    got = [(r.channel, r.place, r.value) for r in out.orderBy("channel", "place").collect()]
    assert got == [(r.channel, r.place, r.value) for r in stored.orderBy("channel", "place").collect()]
    for c in sent:
        mine = [v for channel, _, v in got if channel == c]
        assert mine == sent[c][: len(mine)]  # in order, none lost, none doubled
    assert all(s.pongs >= 1 for s in servers.values())
    messages = chat.normalise("TWITCH", out.select("value"))
    assert messages.count() == len(got) and messages.select("message_id").distinct().count() == len(got)


def received(server, log, wanted, seconds=20):
    """Runs a receiver until the log holds so many lines."""
    r = connectors.Receiver(connectors.LineLog(log, "red"), "127.0.0.1", server.port, connectors.Irc({}), 7, 0.1)
    r.start()
    end = time.time() + seconds
    while connectors.LineLog(log, "red").size() < wanted and time.time() < end:
        time.sleep(0.05)
    r.ended.set()
    r.join(timeout=10)


def test_receiver_loses_and_doubles_nothing(spark, tmp_path):
    sent = [privmsg("red", k) for k in range(120)]
    server = Server(sent, [1, 50, 51, 100], repeat=10)
    server.start()
    log = str(tmp_path / "log")
    received(server, log, 60)  # a first life of the receiver, and a second one that finds the log
    server2 = Server(sent, [90], repeat=1_000)
    server2.start()
    received(server2, log, 120)
    got = [v for b in connectors.LineLog(log, "red").read(0, 1_000) for v in b.column(3).to_pylist()]
    assert got == sent
    state = connectors.channel_states(spark, log).first()
    assert (state.channel, state.state, state.lines) == ("red", "ENDED", 120)


def test_nobody_answers(spark, tmp_path):
    with socket.create_server(("127.0.0.1", 0)) as s:
        port = s.getsockname()[1]
    r = connectors.Receiver(connectors.LineLog(str(tmp_path), "red"), "127.0.0.1", port, connectors.Lines({}))
    r.start()
    time.sleep(0.5)
    r.ended.set()
    r.join(timeout=10)
    state = connectors.channel_states(spark, str(tmp_path)).first()
    assert state.tries >= 1 and state.error and state.lines == 0


def test_recorded_log_and_dropping(spark, tmp_path):
    rows = spark.range(1_000).select((F.col("id") % 3).cast("string").alias("channel"), F.floor(F.col("id") / 3).alias("place"), F.timestamp_seconds("id").alias("received_at"), F.concat(F.lit("line "), "id").alias("value"))
    log = str(tmp_path / "log")
    connectors.record(rows, log, flushLines="50")
    back = spark.read.format("livechat").option("log", log).option("rowsPerPartition", "100").load()
    assert back.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    one = connectors.LineLog(log, "1")
    one.drop(120)
    assert one.size() == 333 and one.segments()[0][0] <= 120 and min(b.column(1)[0].as_py() for b in one.read(0, 999)) == one.segments()[0][0]


def test_bad_options(tmp_path):
    with pytest.raises(ValueError):
        connectors.LineLog(str(tmp_path), "../up")
    with pytest.raises(ValueError):
        connectors.LiveReader({"log": str(tmp_path), "channels": "red"}).addresses()
