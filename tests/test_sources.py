import json

from pyspark.sql import functions as F

from vodlens.sources import chat, tables


def text(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_replay_dialects(spark):
    first = {"comments": [{"_id": "c1", "content_offset_seconds": 1.2, "commenter": {"_id": "u1", "display_name": "Ann"}, "message": {"body": "OMEGALUL hi", "fragments": [{"text": "OMEGALUL", "emoticon_id": "9"}, {"text": " hi"}]}}, {"content_offset_seconds": 0.0, "message": {"body": ""}}]}
    second = [{"message_id": "m1", "time_in_seconds": 3.0, "author": {"id": "u2", "name": "Bob"}, "message": "hello", "emotes": [{"id": "1", "name": "LUL", "count": 2}]}]
    got = chat.replay(text(spark, json.dumps(first), json.dumps(second), "no json")).orderBy("message_id").collect()
    assert [(r.message_id, r.timestamp_offset, r.author_name, r.content) for r in got] == [("c1", 1.2, "Ann", "OMEGALUL hi"), ("m1", 3.0, "Bob", "hello"), ("msg_1", 0.0, "Anonymous", "")]
    assert [e.name for e in got[0].emotes] == ["OMEGALUL"] and got[1].emotes[0]["count"] == 2 and got[2].user_id == "anon"


def test_irc(spark):
    line = r"@badges=subscriber/12,premium/1;color=#FF0000;display-name=Cool\sUser;emotes=25:0-4,6-10/1902:12-16;id=abc;bits=100;tmi-sent-ts=1700000005000;user-id=77 :cooluser!u@h PRIVMSG #chan :Kappa Kappa Keepo"
    parsed = chat.irc(text(spark, line, "PING :tmi.twitch.tv", "@broken", ":prefixonly", ""))
    assert [r.command for r in parsed.collect()] == ["PRIVMSG", "PING"]
    first = parsed.first()
    assert first.tags["display-name"] == "Cool User" and first.prefix == "cooluser!u@h" and first.params == ["#chan"] and first.trailing == "Kappa Kappa Keepo"
    got = chat.twitch(parsed, 1_700_000_000_000.0).collect()
    assert len(got) == 1
    m = got[0]
    assert (m.message_id, m.user_id, m.author_name, m.timestamp_offset) == ("abc", "77", "Cool User", 5.0)
    assert [(e.id, e.name, e["count"]) for e in m.emotes] == [("25", "Kappa", 2), ("1902", "Keepo", 1)]
    assert m.badges == ["subscriber/12", "premium/1"] and json.loads(m.metadata)["monetization"]["amount"] == 100.0


def test_kick(spark):
    payload = {"id": "k1", "content": "hi [emote:12:KEKW] [emote:12:KEKW][emote:7:Pog]", "created_at": "2024-01-01T00:00:10Z", "chatroom_id": 5, "sender": {"id": 3, "username": "zed", "identity": {"badges": [{"type": "subscriber", "count": 4}, {"type": "vip"}]}}}
    got = chat.kick(text(spark, json.dumps(payload), "oops"), stream_start_ms=1_704_067_200_000.0).collect()
    assert len(got) == 1 and got[0].timestamp_offset == 10.0 and got[0].badges == ["subscriber/4", "vip"]
    assert [(e.id, e.name, e["count"]) for e in got[0].emotes] == [("12", "KEKW", 2), ("7", "Pog", 1)]


def test_youtube(spark):
    item = {"message_id": "y1", "timestamp": 1_704_067_210_000_000, "message": [{"text": "go "}, {"emoji": {"emoji_id": "e", "shortcuts": [":fire:"]}}], "author": {"id": "c", "name": "Yo", "badges": [{"title": "Member"}]}, "money": {"amount": 5.0, "currency": "USD"}}
    got = chat.youtube(text(spark, json.dumps(item)), stream_start_ms=1_704_067_200_000.0).first()
    assert got.content == "go :fire:" and got.timestamp_offset == 10.0 and got.badges == ["Member"] and [e.name for e in got.emotes] == [":fire:"]


def test_envelopes(spark, tmp_path):
    rows = spark.createDataFrame([("s1", 1, "a"), ("s2", 2, "b")], "stream_id string, n int, v string")
    env = tables.to_envelopes(rows, "stream_id", "SLICE", F.col("n"), F.lit("2024-01-01T00:00:00Z"))
    path = str(tmp_path / "events")
    tables.write_envelopes(env, path)
    (tmp_path / "events" / "bad.json").write_text("not json\n")
    back = tables.read_envelopes(spark, path, "SLICE", "s2")
    assert [tuple(r) for r in tables.from_envelopes(back, rows.schema).collect()] == [("s2", 2, "b")]


def test_roster(spark, tmp_path):
    (tmp_path / "r.csv").write_text('streamer_id,display_name,channel_urls,enabled,tags\na,Ann,"https://twitch.tv/a;https://kick.com/a",yes,"x,y"\nb,Bob,"[""u1""]",no,\n')
    got = {r.streamer_id: r for r in tables.read_roster(spark, str(tmp_path / "r.csv")).collect()}
    assert got["a"].channel_urls == ["https://twitch.tv/a", "https://kick.com/a"] and got["a"].enabled and got["a"].tags == ["x", "y"]
    assert got["b"].channel_urls == ["u1"] and not got["b"].enabled
    (tmp_path / "r.json").write_text('{"streamers": [{"streamer_id": "c", "display_name": "Cy", "download_priority": "3"}]}')
    assert tables.read_roster(spark, str(tmp_path / "r.json")).first().download_priority == 3


def test_discovery(spark):
    rows = spark.createDataFrame([("https://twitch.tv/videos/1", "v 1", "new", 1_704_067_200, None), ("https://kick.com/x", "2", "old", None, "20200101"), ("https://youtu.be/3", "3", "undated", None, None)], "url string, id string, title string, timestamp long, upload_date string")
    got = tables.discover(rows, F.lit("2023-01-01").cast("timestamp"), 10).collect()
    assert [(r.vod_id, r.platform) for r in got] == [("twitch_v1", "TWITCH"), ("youtube_3", "YOUTUBE")]


def test_manifests_and_checksums(spark, tmp_path):
    folder = tmp_path / "vod9"
    folder.mkdir()
    (folder / "manifest.json").write_text(json.dumps({"stage_outputs": {"claims": [{"claim_id": "c1"}]}}))
    assert [tuple(r) for r in tables.read_manifests(spark, f"{tmp_path}/*/manifest.json", "claims", "struct<claim_id:string>").collect()] == [("vod9", "c1")]
    import hashlib

    good = hashlib.sha256((folder / "manifest.json").read_bytes()).hexdigest()
    expected = spark.createDataFrame([("manifest.json", good), ("missing.json", "0")], "name string, sha256 string")
    assert [tuple(r) for r in tables.verify_checksums(spark, str(folder), expected).select("name", "is_valid").collect()] == [("manifest.json", True)]


def test_chat_store(spark, tmp_path):
    rows = spark.createDataFrame([("s", "v", 2, "b"), ("s", "v", 1, "a")], "streamer_id string, vod_id string, timestamp_ms long, message_text string")
    tables.write_chat(rows, str(tmp_path / "chat"))
    assert spark.read.parquet(str(tmp_path / "chat")).where("streamer_id = 's'").count() == 2
