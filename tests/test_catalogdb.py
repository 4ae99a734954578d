"""SQLite tables as a source: typed rows, partitions, pushed filters, shards."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, Not, StringEndsWith

from vodlens.sources import catalogdb


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "catalog.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE streamer_targets (streamer_id TEXT PRIMARY KEY, display_name TEXT, channel_urls TEXT, download_priority INTEGER, tags TEXT, enabled INTEGER, created_at TEXT, voiceprint_embedding TEXT)")
        rows = [
            ("ann", "Ann", '["https://a/x", "https://b/y"]', 9, '["talk"]', 1, "2024-01-02T03:04:05Z", "[0.5, 1]"),
            ("bob", "Bob", "https://one", 1, "plain", 0, "not a time", "broken"),
            ("çay", None, None, None, "", None, None, None),
        ]
        c.executemany("INSERT INTO streamer_targets VALUES (?,?,?,?,?,?,?,?)", rows)
        c.execute("CREATE TABLE harvested_vods (vod_id TEXT PRIMARY KEY, streamer_id TEXT, status TEXT, duration_sec REAL, published_at TEXT, raw_metadata TEXT)")
        c.executemany("INSERT INTO harvested_vods VALUES (?,?,?,?,?,?)", [(f"v{k}", "ann" if k % 3 else "bob", ["QUEUED", "strange", "ANALYZED"][k % 3], k / 2, f"2024-01-{k % 28 + 1:02d}T00:00:00", '{"a": "x", "n": {"b": 1}}' if k % 2 else "oops") for k in range(500)])
        c.execute("CREATE TABLE no_rows (x TEXT)")
    return path


def test_typed_rows(spark, database):
    rows = {r.streamer_id: r for r in catalogdb.targets(spark, database).collect()}
    ann, bob, cay = rows["ann"], rows["bob"], rows["çay"]
    assert (ann.channel_urls, ann.tags, ann.enabled, ann.voiceprint_embedding) == (["https://a/x", "https://b/y"], ["talk"], True, [0.5, 1.0])
    assert ann.created_at is not None and ann.primary_platform is None
    assert (bob.channel_urls, bob.tags, bob.enabled, bob.created_at, bob.voiceprint_embedding) == (["https://one"], ["plain"], False, None, None)
    assert (cay.display_name, cay.channel_urls, cay.tags, cay.download_priority) == (None, None, [], None)


def test_states_and_metadata(spark, database):
    got = {r.vod_id: r for r in catalogdb.vods(spark, database, rowsPerPartition="60").collect()}
    assert len(got) == 500 and got["v1"].status == "DISCOVERED" and got["v1"].raw_metadata == {"a": "x", "n": '{"b": 1}'} and got["v2"].raw_metadata == {}


CASES = ["status = 'QUEUED' AND duration_sec > 100", "vod_id IN ('v1', 'v2', 'none')", "NOT (status = 'QUEUED')", "status <=> 'QUEUED'", "vod_id LIKE 'v4%' AND duration_sec <= 22.5", "duration_sec IS NULL", "published_at > timestamp'2024-01-20'", "status = 'QUEUED' OR duration_sec < 3", "raw_metadata IS NULL"]


@pytest.mark.parametrize("where", CASES)
def test_filters(spark, database, where):
    schema = "vod_id string, status string, duration_sec double, published_at timestamp, raw_metadata map<string,string>"
    df = catalogdb.read_table(spark, database, "harvested_vods", schema, rowsPerPartition="60")
    assert df.rdd.getNumPartitions() == 9
    every = spark.createDataFrame(df.collect(), df.schema)
    key = lambda rows: sorted(r.vod_id for r in rows)
    assert key(df.where(where).collect()) == key(every.where(where).collect())


def test_pushed_filters_are_in_the_plan_and_cut_the_rows(spark, database):
    df = catalogdb.read_table(spark, database, "harvested_vods", "vod_id string, status string").where("status = 'ANALYZED'").select("vod_id")
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,ANALYZED)]" in plan and "Filter (" not in plan
    schema = T.StructType.fromDDL("vod_id string, status string")
    reader = catalogdb.TableReader(schema, {"path": database, "table": "harvested_vods", "rowsperpartition": "100000"})
    left = list(reader.pushFilters([EqualTo(("status",), "ANALYZED"), Not(EqualTo(("vod_id",), "v2")), StringEndsWith(("vod_id",), "5")]))
    assert [type(f) for f in left] == [StringEndsWith]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 165 and {r[1] for r in rows} == {"ANALYZED"}


def test_shards(spark, tmp_path):
    rows = spark.range(1_000).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("é"), "id")).alias("name"), F.array("id", F.lit(None).cast("long")).alias("list"), F.timestamp_seconds("id").alias("at"), (F.col("id") % 2 == 0).alias("even"), F.struct("id", F.lit("x").alias("x")).alias("s"))
    path = f"file://{tmp_path}/shards"
    catalogdb.write_tables(rows.repartition(4, "id"), path, "odd \" name")
    schema = "id long, name string, list array<long>, at timestamp, even boolean, s struct<id:long,x:string>, missing string"
    back = catalogdb.read_table(spark, path, "odd \" name", schema, rowsPerPartition="100")
    assert back.rdd.getNumPartitions() >= 10
    assert sorted(map(tuple, back.drop("missing").collect())) == sorted(map(tuple, rows.collect()))
    assert back.where("missing IS NULL AND id < 10").count() == 10


def test_empty_table(spark, database):
    assert catalogdb.read_table(spark, database, "no_rows", "x string").count() == 0
