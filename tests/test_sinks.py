import pytest

from vodlens.operators import search
from vodlens.sources import sinks, tables


def test_rosters_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "An, n", ["u1", "u2"])], "streamer_id string, display_name string, channel_urls array<string>")
    sinks.write_roster(rows, str(tmp_path / "r.csv"), "csv")
    got = tables.read_roster(spark, str(tmp_path / "r.csv")).first()
    assert got.display_name == "An, n" and got.channel_urls == ["u1", "u2"]
    with pytest.raises(ValueError):
        sinks.write_roster(rows, str(tmp_path / "x"), "xml")


def test_chunks_are_replaced(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sinks.write_chunk(spark.createDataFrame([(0, "a"), (1, "b")], "chunk int, v string"), path)
    sinks.write_chunk(spark.createDataFrame([(1, "c")], "chunk int, v string"), path)
    assert sorted((r.chunk, r.v) for r in spark.read.parquet(path).collect()) == [(0, "a"), (1, "c")]
    assert sorted(r.chunk for r in sinks.completed_chunks(spark, path).collect()) == [0, 1]


def test_reports(spark):
    rows = spark.createDataFrame([(2, "<b>|"), (1, None)], "i int, t string")
    assert "<td>&lt;b&gt;|</td>" in sinks.report_html("T & U", rows, ["i"])
    assert sinks.deck_markdown("T", rows, ["i"]).splitlines()[4:] == ["| 1 |  |", "| 2 | <b>\\| |"]
    events = spark.createDataFrame([(1, "Dialogue: x")], "line_no int, event string")
    assert sinks.subtitle_file(events, ["line_no"]).endswith("Text\nDialogue: x\n")


def test_chunk_filters(spark):
    rows = [("s1", "v1", "speech", 1.0, '{"k": "a"}'), ("s1", "v2", "chat", 5.0, '{"k": "b"}'), ("s2", "v3", "speech", 9.0, None)]
    c = spark.createDataFrame(rows, "streamer_id string, vod_id string, content_type string, timestamp_sec double, metadata string")
    assert search.filtered(c, streamer_ids=["s1"], content_types=["speech"]).count() == 1
    assert search.filtered(c, start=2.0, end=6.0).first().vod_id == "v2" and search.filtered(c, metadata={"k": "b"}).count() == 1 and search.filtered(c).count() == 3
    assert {r.content_type: r.n_vods for r in search.index_stats(c).collect()} == {"speech": 2, "chat": 1}
