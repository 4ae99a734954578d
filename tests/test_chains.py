"""The operators behind the chains on hand-made rows."""

from pyspark.sql import functions as F

from vodlens.operators import index, knowledge, production, registry
from vodlens.plans import wider


def test_publication_without_highlights(spark):
    bounds = spark.createDataFrame([(1, 7_300.0), (2, 4_000.0)], "s long, duration double")
    high = spark.createDataFrame([(1, 10, 2_000.0, 0.9), (1, 11, 2_100.0, 0.7), (1, 12, 3_500.0, 0.65), (1, 13, 3_600.0, 0.2)], "s long, i long, t double, score double")
    chapters = production.macro_chapters(high, bounds, ["s"], "i", "t", "score")
    got = {r.s: r for r in production.publication(chapters, high, bounds, ["s"], F.lit("Ann"), "t", "score", "i", wider.LABELS).collect()}
    assert got[1].chapter_lines == ["00:00 - Start", "33:20 - Peak 1", "58:20 - Climax 2", "01:56:40 - Close"] and got[1].thumbnails == [2_000.0, 2_100.0, 3_500.0]
    assert got[2].chapter_lines == ["00:00 - Start", "01:01:40 - Close"] and got[2].thumbnails == [1_000.0, 2_000.0] and got[2].recap[0] == "Live for 01:06:40 with 0 highlight moments."
    assert got[1].titles[2] == "All of it live: 2 hours with Ann" and got[1].tags[0] == "ann" and "33:20 - Peak 1" in got[1].description


def test_context_and_reindexing(spark):
    chunks = spark.createDataFrame([("v", "a", 100.0, "some text", "v"), ("v", "b", 500.0, "", "v"), ("w", "c", 100.0, "x", "w")], "stream_id string, chunk_id string, timestamp_sec double, text string, vod_id string")
    chat = spark.createDataFrame([("v", k, 95.0 + k, f"u{k}", f"m{k}") for k in range(30)], "stream_id string, message_id long, timestamp_offset double, author_name string, content string")
    got = {r.chunk_id: r for r in index.with_embeddings(index.with_context(chunks, chat, ["stream_id"])).collect()}
    assert [m.text for m in got["a"].chat_context] == [f"m{k}" for k in range(10)] and got["b"].chat_context == [] and got["c"].chat_context == []
    assert abs(sum(x * x for x in got["a"].embedding) - 1) < 1e-9 and not any(got["b"].embedding)
    batch = chunks.where("chunk_id = 'a'").withColumn("chunk_id", F.lit("z"))
    assert sorted(r.chunk_id for r in index.reindexed(chunks, batch).collect()) == ["c", "z"]
    assert sorted(r.chunk_id for r in index.reindexed(chunks, batch.limit(0), ["w"]).collect()) == ["a", "b"]


def test_citations(spark):
    q = spark.createDataFrame([(1, "All NATION s"), (2, "x de y"), (3, "é/ü a+b & more than thirty characters here"), (4, None), (5, "")], "i long, t string")
    got = {r.i: r for r in knowledge.offline_citations(q, "i", "t", wider.RULES, wider.FALLBACK).collect()}
    assert [got[k].domain for k in (1, 2, 3, 4, 5)] == ["one.example", "two.example"] + ["wiki.example"] * 3
    assert got[3].url == "https://wiki.example/%C3%A9/%C3%BC%20a%2Bb%20%26%20more%20than%20thirty%20cha" and got[4].url == "https://wiki.example/"


def test_sampling_report(spark):
    runs = spark.createDataFrame([(1, 100.0, 2.0), (2, 10.0, 2.0)], "run_id long, duration_sec double, interval_sec double")
    frames = spark.createDataFrame([(1, float(t)) for t in range(0, 100, 10)], "run_id long, t double")
    bursts = spark.createDataFrame([(1, 9.0, 11.0), (1, 11.5, 12.0), (1, 20.0, 20.0), (1, 20.0, 20.0)], "run_id long, lo double, hi double")
    got = {r.run_id: r for r in registry.sampling_report(runs, frames, bursts).collect()}
    assert tuple(got[1]) == (1, 6_000, 51, 10, 41, 80.39, 3.28, 66.67) and tuple(got[2]) == (2, 600, 6, 0, 6, 100.0, 0.48, 100.0)


def test_feeders(spark, tmp_path):
    from vodlens.operators import feeders
    from vodlens.sources import state

    targets = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [])], "streamer_id string, voiceprint_embedding array<double>")
    later = spark.createDataFrame([("a", 1, [0.0, 1.0]), ("d", 5, [2.0, 0.0])], "streamer_id string, sample_id long, embedding array<double>")
    got = {r.streamer_id: (r.sample_count, r.centroid) for r in feeders.seed_voiceprints(targets, later).collect()}
    assert set(got) == {"a", "d"} and got["a"][0] == 2 and abs(got["a"][1][0] - 0.5**0.5) < 1e-12 and got["d"][1] == [2.0, 0.0]
    kept = state.StateTable(spark, str(tmp_path / "chatters"))
    chat = spark.createDataFrame([(k, k % 2, f"u{k % 2}", "KEKW that was W" if k % 2 else "uninstall trash") for k in range(6)], "message_id long, user_id long, author_name string, content string")
    fail = lambda df: 1 / 0
    told = feeders.fan(chat, {"first": lambda df: feeders.chatter_safety(kept, df, "s1"), "broken": fail, "again": lambda df: feeders.chatter_safety(kept, df, "s2")})
    assert told["first"] is None and told["again"] is None and told["broken"].startswith("ZeroDivisionError")
    assert kept.read().count() == 6 and {r.vod_id for r in kept.read().collect()} == {"s1"}
    assert {r.user_id: r.total_messages for r in feeders.chatter_profiles(kept).collect()} == {0: 3, 1: 3}


def test_inserted_chunks_have_an_end(spark):
    cols = "chunk_id string, timestamp_sec double, timestamp_end_sec double, text string"
    out = index.insert(spark.createDataFrame([("a", 1.0, 2.0, "x")], cols), spark.createDataFrame([("b", 3.0, None, "y"), ("c", 1.0, None, " ")], cols))
    assert sorted((r.chunk_id, r.timestamp_end_sec) for r in out.collect()) == [("a", 2.0), ("b", 8.0)]


def test_storage_levels(spark, tmp_path):
    from vodlens.operators import media

    (tmp_path / "Shorts").mkdir()
    for name, size in (("a_Proxy.mp4", 10), ("Shorts/x.bin", 20), ("my_short.txt", 30), ("other", 40)):
        (tmp_path / name).write_bytes(b"x" * size)
    files = media.stored_files(spark, str(tmp_path))
    level = lambda budget, free=100 << 30: tuple(media.storage_usage(files, budget, free).first())
    assert level(1_000) == (100, 1, 2, 10.0, "NORMAL") and level(130)[4] == "WARNING" and level(110)[4] == "CRITICAL" and level(100)[4] == "HALT" and level(1_000, 1)[4] == "HALT"
