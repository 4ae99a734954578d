import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from vodlens.sources import chat, live, sinks
from vodlens.streaming import coordinator
from vodlens.streaming import live as streams

BODY = json.dumps({"event": "chat.message.sent", "data": {"id": "m1", "content": "hi é", "sender": {"id": "7", "username": "ann"}, "created_at": "1700000000"}})


def test_hmac_equals_the_library(spark):
    for secret in ("s", "a longer secret " * 9):
        rows = spark.createDataFrame([(BODY,), ("",), ("x" * 5000,)], "body string").select("body", live.hmac_sha256(secret, F.col("body")).alias("h"))
        assert all(r.h == hmac.new(secret.encode(), r.body.encode(), hashlib.sha256).hexdigest() for r in rows.collect())


def test_webhook(spark):
    sign = lambda body: hmac.new(b"key", body.encode(), hashlib.sha256).hexdigest()
    other = json.dumps({"event": "livestream.status.updated"})
    rows = spark.createDataFrame([(BODY, sign(BODY)), (BODY, "wrong"), (BODY, None), (other, sign(other)), ("not json", sign("not json"))], "body string, signature string")
    assert [(r.message_id, r.content, r.author_name) for r in live.kick_webhook(rows, "key").collect()] == [("m1", "hi é", "ann")]
    assert live.kick_webhook(rows).count() == 3


def test_youtube_api(spark):
    item = {"id": "a", "snippet": {"displayMessage": "hello", "publishedAt": "2024-01-01T00:01:00Z", "superChatDetails": {"amountMicros": "5000000", "currency": "EUR"}}, "authorDetails": {"displayName": "Bo", "channelId": "c", "isChatOwner": True, "isVerified": True, "isChatModerator": False}}
    rows = spark.createDataFrame([(json.dumps(item),), ("{}",), ("broken",)], "value string")
    got = {r.content: r for r in live.youtube_api(rows, stream_start_ms=1704067200000.0).collect()}
    assert len(got) == 2 and got["hello"].badges == ["Owner", "Verified"] and got["hello"].timestamp_offset == 60.0
    assert json.loads(got["hello"].metadata)["monetization"]["amount"] == 5.0 and got[""].author_name == "Anonymous"


def test_streamed_chat_and_registration(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("@id=1;display-name=Ann :ann!a@b PRIVMSG #c :hello there\nPING :x\n")
    got = streams.run_available(live.stream_chat(spark, "TWITCH", path=str(tmp_path / "in")).select("message_id", "content"), "chat")
    assert [(r.message_id, r.content) for r in got.collect()] == [("1", "hello there")]
    live.register("PLAIN", lambda df, **o: df.selectExpr("value AS content"))
    try:
        assert chat.normalise("PLAIN", spark.createDataFrame([("x",)], "value string")).first().content == "x"
    finally:
        del chat.NORMALISERS["PLAIN"]


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"width": 3, "name": "file"}')
    out = live.settings({"width": 2, "name": "a", "on": False, "none": None}, str(tmp_path / "c.json"), environment={"VODLENS_ON": "true", "VODLENS_WIDTH": "5", "VODLENS_OTHER": "1", "PATH": "x"})
    assert out == {"width": 5, "name": "file", "on": True, "none": None}


def test_envelope_table(spark, tmp_path):
    rows = spark.createDataFrame([("1.0", "a", "s1"), ("1.0", "b", "s2")], "version string, message_id string, stream_id string")
    rows.write.parquet(str(tmp_path / "e"))
    df = live.read_envelope_table(spark, str(tmp_path / "e"), "s2")
    assert [r.message_id for r in df.collect()] == ["b"] and "EqualTo(stream_id,s2)" in df._jdf.queryExecution().executedPlan().toString()


def test_backoff_and_supervision():
    assert [coordinator.backoff(k, draw=lambda: 0.0) for k in (1, 2, 3, 6, 9)] == [2, 4, 8, 60, 60] and coordinator.backoff(9, draw=lambda: 1.0) == 90
    waits, runs = [], []

    class Query:
        def awaitTermination(self):
            runs.append(1)
            if len(runs) < 3:
                raise RuntimeError("lost")

    assert coordinator.supervised(Query, sleep=waits.append, draw=lambda: 0.0) == 3 and waits == [2, 4]
    with pytest.raises(RuntimeError):
        coordinator.supervised(lambda: (_ for _ in ()).throw(RuntimeError("never")), attempts=2, sleep=waits.append)


def test_ingest_velocity(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 1.0)], "k int, t double").write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema("k int, t double").parquet(str(tmp_path / "v"))
    got = streams.run_available(coordinator.ingest_velocity(stream, ["k"], "10 seconds", "10 seconds"), "velocity", "complete")
    assert {(r.k, r.n, r.velocity) for r in got.collect()} == {(1, 2, 0.2), (2, 1, 0.1)}


def test_finished_parts_and_lines(spark, tmp_path):
    sinks.write_chunk(spark.createDataFrame([(0, "a"), (2, "b")], "chunk int, v string"), f"{tmp_path}/audio")
    got = sinks.finished(spark, str(tmp_path), ["audio", "vision"])
    assert sorted((r.phase, r.chunk) for r in got.collect()) == [("audio", 0), ("audio", 2)]
    events = spark.range(500).selectExpr("id", "concat('line ', id) AS event").repartition(7)
    sinks.write_subtitles(events, ["id"], str(tmp_path / "subtitles"))
    (path,) = (tmp_path / "subtitles").glob("part-*")
    assert path.read_text().splitlines() == [*sinks.SUBTITLE_HEAD, *(f"line {k}" for k in range(500))]
    with pytest.raises(ValueError):
        sinks.subtitle_file(events, ["id"], most=10)
