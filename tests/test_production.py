import datetime as dt

import pytest
from pyspark.sql import functions as F

from vodlens.operators import folds, index, production, registry
from vodlens.plans.rpc import Dispatcher

BOX = "array<struct<label:string,confidence:double,box:array<double>>>"


def test_chat_evidence(spark):
    chat = spark.createDataFrame([(1, k, float(k), t) for k, t in enumerate(["Wow! wow", "http://x wow", "ok no", "late late"] + ["far away"] * 6)], "s long, message_id long, timestamp_offset double, content string")
    c = spark.createDataFrame([(1, "a", 0.0, 2.0), (1, "b", 50.0, 51.0), (2, "c", 0.0, 9.0)], "s long, item string, lo double, hi double")
    got = {r.item: r for r in production.chat_evidence(c, chat, ["s"], "item", "lo", "hi").collect()}
    assert got["a"].dominant == ["wow"] and got["b"].dominant == [] and got["a"].z == pytest.approx((3 / 2 - 10 / 9) / (0.5 * 10 / 9)) and got["b"].z == 0 and got["c"].z == 1.5


def test_hooks(spark):
    said = spark.createDataFrame([(1, 1, 0.0, 200.0, "long before  it " + "w " * 20), (1, 2, 90.0, 95.0, "second"), (1, 3, 500.0, 501.0, "after")], "s long, segment_id long, start_sec double, end_sec double, transcript string")
    c = spark.createDataFrame([(1, "a", 80.0, 120.0), (1, "b", 300.0, 301.0)], "s long, item string, lo double, hi double")
    got = {r.item: r for r in production.hooks(c, said, ["s"], "item", "lo", "hi").collect()}
    assert got["a"].hook == "long before it " + " ".join("w" * 9) + "..." and got["a"].summary.endswith("second") and got["b"].hook == got["b"].summary == ""


def test_cut_plans_take_the_first_telling_frame(spark):
    frames = spark.createDataFrame([(1, 1, 5.0, "GAMEPLAY", [("chair", 0.9, [0.0, 0.0, 1.0, 1.0])]), (1, 2, 6.0, "GAMEPLAY", [("Person", 0.9, [0.1, 0.2, 0.15, 0.9])]), (1, 3, 7.0, "FULLSCREEN_CAM", [])], f"s long, frame_index long, timestamp_sec double, scene_type string, detected_objects {BOX}")
    c = spark.createDataFrame([(1, "a", 0.0, 9.0, "HYPE", 3.0), (1, "b", 6.5, 9.0, "SHOCK", 1.0), (1, "c", 50.0, 60.0, "CALM", 1.0)], "s long, item string, lo double, hi double, e string, z double")
    got = {r.item: r for r in production.cut_plans(c, frames, ["s"], "item", "lo", "hi", "e", "z").collect()}
    assert tuple(got["a"].facecam) == pytest.approx((0.2, 0.1, 0.7, 0.2)) and tuple(got["b"].facecam) == production.FULL_CAM and tuple(got["c"].facecam) == production.CAM
    assert [got[k].highlight_colour for k in "abc"] == ["&H0000FF00", "&H000000FF", production.OTHER_COLOUR] and got["a"].duck_db == -14.0


def test_hashtags(spark):
    rows = spark.createDataFrame([(["kekw", "ab", "viral"], True)], "d array<string>, ad boolean").select(production.hashtags(F.col("d"), F.col("ad"), ["rizz", "kekw"]).alias("t"))
    assert rows.first().t == [*production.BASE_TAGS, "#kekw", "#rizz", "#ad"]


def test_macro_chapters(spark):
    h = spark.createDataFrame([(1, 1, 100.0, 0.9), (1, 2, 1000.0, 0.7), (1, 3, 1500.0, 0.99), (1, 4, 2000.0, 0.9), (1, 5, 3000.0, 0.1)], "s long, item long, t double, score double")
    b = spark.createDataFrame([(1, 4000.0), (2, 60.0)], "s long, duration double")
    got = sorted((r.s, r.t, r.kind) for r in production.macro_chapters(h, b, ["s"], "item", "t", "score").collect())
    assert got == [(1, 0.0, "start"), (1, 1000.0, "climax"), (1, 2000.0, "peak"), (1, 3700.0, "close"), (2, 0.0, "start")]


def test_sampling_plan(spark):
    b = spark.createDataFrame([(1, 20.0), (2, 0.0)], "s long, duration double")
    hot = spark.createDataFrame([(1, 4.0, 6.0), (1, 5.0, 7.0)], "s long, lo double, hi double")
    cuts = spark.createDataFrame([(1, 9.95), (1, 12.0), (1, 99.0)], "s long, cut double")
    got = sorted(r.timestamp_sec for r in folds.sampling_plan(b, hot, cuts, ["s"], 0.5, 5.0).collect())
    assert got == [0.0, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 10.05, 12.1, 12.5, 17.5]
    assert folds.merged_spans([(5, 7), (1, 2), (4, 6), (2, 2)]) == ([1, 4], [2, 7])


def test_chunk_index(spark):
    base = spark.createDataFrame([("a", "v1", "t"), ("b", "v2", "u")], "chunk_id string, vod_id string, text string")
    more = spark.createDataFrame([("b", "v2", "new"), ("c", "v3", "  ")], "chunk_id string, vod_id string, text string")
    both = index.insert(base, more)
    assert sorted((r.chunk_id, r.text) for r in both.collect()) == [("a", "t"), ("b", "new")]
    assert [r.chunk_id for r in index.delete_vod(both, "v1").collect()] == ["b"] and index.get(both, ["a", "z"]).count() == 1


def test_one_baseline_at_most(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    schema = "run_id string, timestamp timestamp, is_baseline boolean"
    first = registry.record_runs(spark.createDataFrame([], schema), spark.createDataFrame([("a", day(1), True), ("b", day(2), False)], schema))
    assert registry.baseline(first).first().run_id == "a"
    second = registry.record_runs(first, spark.createDataFrame([("c", day(3), False)], schema))
    assert registry.baseline(second).first().run_id == "a"
    third = registry.record_runs(second, spark.createDataFrame([("d", day(4), True), ("e", day(5), True)], schema))
    assert [r.run_id for r in third.where("is_baseline").collect()] == ["e"] and [r.run_id for r in registry.recent(third, 2).collect()] == ["e", "d"]


def test_stage_log(spark):
    log = registry.StageLog("r1")
    with log.stage("one"):
        pass
    with pytest.raises(KeyError), log.stage("two"):
        raise KeyError("x")
    rows = {r.stage_name: r for r in log.table(spark).collect()}
    assert rows["one"].status == "SUCCESS" and rows["two"].status == "ERROR" and rows["one"].end_time >= rows["one"].start_time
    total = registry.run_totals(log.table(spark), 10.0).first()
    assert (total.n_stages, total.n_failed) == (2, 1) and total.real_time_factor >= 0


def test_rpc_schemas_and_streams(spark, tmp_path):
    d = Dispatcher(spark, "", {"q": lambda s, p: s.range(1)})
    assert d.handle({"method": "listSchemas"})["result"] == ["q"] and d.handle({"method": "getJsonSchema", "params": {"name": "q"}})["result"]["fields"][0]["name"] == "id"
    spark.range(3).write.parquet(str(tmp_path / "in"))
    d.register_stream("tail", lambda p: spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start())
    assert d.handle({"method": "startLiveTail", "params": {"name": "tail"}})["result"]["active"]
    d.running["tail"].processAllAvailable()
    assert d.handle({"method": "getLiveStatus", "params": {"name": "tail"}})["result"]["error"] is None
    assert not d.handle({"method": "stopLiveTail", "params": {"name": "tail"}})["result"]["active"]
    assert d.handle({"method": "startLiveTail", "params": {"name": "none"}})["error"]["code"] == -32602


def test_uuid5_equals_the_library(spark):
    import uuid

    from vodlens.functions import columns as C

    rows = spark.createDataFrame([("a",), ("é long name",), ("",), *[(str(k),) for k in range(40)]], "n string").select("n", C.uuid5(str(uuid.NAMESPACE_URL), F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in rows.collect())
