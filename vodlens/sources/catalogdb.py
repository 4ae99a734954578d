"""Catalog and audit databases: SQLite files as a partitioned Spark source with filter pushdown.

`spark.read.schema(...).format("sqlitetable").option("table", t).load(path)` reads one file or a folder
of shards (each a file of the same tables). A partition is a range of row ids of one shard. Comparisons
of text and number columns go to the database as a WHERE clause with parameters; only the columns of
the schema are selected. What a database keeps as text comes out typed, by the schema: JSON texts as
arrays, maps and structs (a text that is no JSON list is its one element), ISO times as timestamps,
numbers as booleans. A value that can't be read is null, as is a column that the table lacks.

`write_tables(df, path, table)` writes shards, one for each task, each complete before it has its name.

Files in another store than a mounted one are copied to the task's own disk while it reads or writes.
"""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import closing, contextmanager
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith, WriterCommitMessage

from vodlens.plans.session import ship_package
from vodlens.sources.connectors import opened

SUFFIX = ".sqlite"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualNullSafe: "IS"}
#: Kinds whose values the database compares as Spark does.
PLAIN = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.DoubleType)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def condition(f: Filter, schema: T.StructType) -> tuple[str, list] | None:
    """A filter as SQL with parameters; None for what the database would judge otherwise than Spark."""
    if isinstance(f, Not):
        inner = condition(f.child, schema)
        return (f"NOT ({inner[0]})", inner[1]) if inner else None
    name = f.attribute[0]
    if len(f.attribute) > 1 or name not in schema.names:
        return None
    column = quoted(name)
    if isinstance(f, (IsNull, IsNotNull)):
        return (f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []) if isinstance(schema[name].dataType, PLAIN) else None
    if not isinstance(schema[name].dataType, PLAIN):
        return None
    values = list(f.value) if isinstance(f, In) else [f.value]
    text = isinstance(schema[name].dataType, T.StringType)
    if any(v is not None and (isinstance(v, str) != text or not isinstance(v, (str, int, float))) for v in values):
        return None
    if isinstance(f, In):
        return f"{column} IN ({', '.join('?' * len(values))})", values
    if isinstance(f, StringStartsWith):
        return (f"substr({column}, 1, ?) = ?", [len(f.value), f.value]) if text else None
    if type(f) in COMPARED:
        return f"{column} {COMPARED[type(f)]} ?", values
    return None


def typed(value, kind: T.DataType):
    """A stored value as the schema's kind."""
    if value is None:
        return None
    try:
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return _shaped(_decoded(value, kind), kind)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            t = datetime.fromtimestamp(value, timezone.utc) if isinstance(value, (int, float)) else datetime.fromisoformat(value)
            t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
            return t if isinstance(kind, T.TimestampType) else t.astimezone(timezone.utc).replace(tzinfo=None)
        if isinstance(kind, T.BooleanType):
            return value.strip().lower() in ("1", "true", "yes", "t") if isinstance(value, str) else bool(value)
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        if isinstance(kind, T.IntegralType):
            return int(value)
        return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
    except (ValueError, TypeError, OverflowError):
        return None


def _decoded(value, kind: T.DataType):
    try:
        return json.loads(value)
    except ValueError:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return [value] if value else []
        raise


def _shaped(value, kind: T.DataType):
    """A decoded JSON value in the shape of the schema."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_shaped(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return {str(k): _shaped(x, kind.valueType) for k, x in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, T.StructType):
        return tuple(_shaped(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return json.dumps(value)
    return typed(value, kind)


@contextmanager
def local_file(uri: str) -> Iterator[str]:
    """A path that SQLite can open: the file itself where it is mounted, else a copy for as long as it is needed."""
    files, path = opened(uri)
    if isinstance(files, fs.LocalFileSystem):
        yield path
        return
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, "copy")
        fs.copy_files(path, copy, source_filesystem=files, destination_filesystem=fs.LocalFileSystem())
        yield copy


@contextmanager
def database(uri: str) -> Iterator[sqlite3.Connection]:
    with local_file(uri) as path, closing(sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)) as c:
        yield c


def shards(uri: str) -> list[str]:
    """The database files of a path."""
    files, root = opened(uri)
    head = uri[: len(uri) - len(root.lstrip("/"))] if "://" in uri else ""
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [uri]
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(root)) if f.path.endswith(SUFFIX))
    return [f"{head}{p.lstrip('/')}" if head else p for p in found]


class Rows(InputPartition):
    """A range of row ids of one shard."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class TableReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            found = condition(f, self.schema)
            if found:
                self.where.append(found)
            else:
                yield f

    def partitions(self) -> list[Rows]:
        size, out = int(self.options.get("rowsperpartition", 100_000)), []
        for path in shards(self.options["path"]):
            with database(path) as c:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
            if low is not None:
                out += [Rows(path, at, min(at + size, high + 1)) for at in range(low, high + 1, size)]
        return out

    def read(self, partition: Rows | None) -> Iterator[tuple]:
        if partition is None:  # Spark's way to read a source without partitions
            return
        table, kinds = self.options["table"], [f.dataType for f in self.schema]
        with database(partition.path) as c:
            there = {r[1] for r in c.execute(f"PRAGMA table_info({quoted(table)})")}
            columns = ", ".join(quoted(f.name) if f.name in there else f"NULL AS {quoted(f.name)}" for f in self.schema)
            inner = f"SELECT {columns} FROM {quoted(table)} WHERE rowid >= ? AND rowid < ?"
            values = [partition.first, partition.last]
            if self.where:
                inner = f"SELECT * FROM ({inner}) WHERE {' AND '.join(f'({w})' for w, _ in self.where)}"
                values += [v for _, vs in self.where for v in vs]
            for row in c.execute(inner, values):
                yield tuple(typed(v, k) for v, k in zip(row, kinds))


def stored_value(value):
    """A value as SQLite keeps it: lists, maps and rows as JSON, times as ISO texts, booleans as numbers."""
    if isinstance(value, datetime):
        return (value if value.tzinfo is None else value.astimezone(timezone.utc)).isoformat()
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, dict, T.Row)):
        return json.dumps(value.asDict(True) if isinstance(value, T.Row) else value, ensure_ascii=False, default=str)
    return value


class Done(WriterCommitMessage):
    def __init__(self, temporary: str | None):
        self.temporary = temporary


class TableWriter(DataSourceWriter):
    """A shard for each task, under a temporary name until all of them are there."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)

    def write(self, rows: Iterator[T.Row]) -> Done:
        files, root = opened(self.options["path"])
        files.create_dir(root, recursive=True)
        table = quoted(self.options["table"])
        with tempfile.TemporaryDirectory() as folder:
            local = os.path.join(folder, "shard")
            with closing(sqlite3.connect(local)) as c:
                c.execute(f"CREATE TABLE {table} ({', '.join(quoted(f.name) for f in self.schema)})")
                n = c.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(self.schema))})", (tuple(map(stored_value, r)) for r in rows)).rowcount
                c.commit()
            if n <= 0:
                return Done(None)
            temporary = f"{root.rstrip('/')}/_{uuid.uuid4().hex}"
            fs.copy_files(local, temporary, source_filesystem=fs.LocalFileSystem(), destination_filesystem=files)
            return Done(temporary)

    def commit(self, messages: list[Done | None]) -> None:
        files, _ = opened(self.options["path"])
        for m in messages:
            if m is not None and m.temporary:
                head, _, name = m.temporary.rpartition("/_")
                files.move(m.temporary, f"{head}/{name}{SUFFIX}")

    def abort(self, messages: list[Done | None]) -> None:
        files, _ = opened(self.options["path"])
        for m in messages:
            if m is not None and m.temporary:
                files.delete_file(m.temporary)


class SqliteTable(DataSource):
    """The format `sqlitetable`."""

    @classmethod
    def name(cls) -> str:
        return "sqlitetable"

    def schema(self) -> str:
        raise ValueError("give the rows' schema: a database keeps lists and times as text")

    def reader(self, schema: T.StructType) -> TableReader:
        return TableReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> TableWriter:
        return TableWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    ship_package(spark)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(SqliteTable)


def read_table(spark: SparkSession, path: str, table: str, schema: str, **options) -> DataFrame:
    """A table of a database file or of a folder of shards."""
    register(spark)
    return spark.read.format("sqlitetable").schema(schema).options(table=table, **options).load(path)


def write_tables(df: DataFrame, path: str, table: str) -> None:
    register(df.sparkSession)
    df.write.format("sqlitetable").mode("append").option("table", table).save(path)


TARGETS = "streamer_id string, display_name string, channel_urls array<string>, primary_platform string, download_priority int, tags array<string>, include_chat boolean, enabled boolean, voiceprint_embedding array<double>, created_at timestamp, last_synced_at timestamp"
VODS = "vod_id string, streamer_id string, platform string, title string, published_at timestamp, duration_sec double, status string, file_size_bytes long, retry_count int, error_message string, raw_metadata map<string,string>, harvested_at timestamp, analyzed_at timestamp"
#: The states of a recording; any other counts as the first.
STATES = ["DISCOVERED", "QUEUED", "DOWNLOADING", "HARVESTED", "READY_FOR_ANALYSIS", "ANALYZING", "ANALYZED", "ERROR", "FAILED"]


def targets(spark: SparkSession, path: str, **options) -> DataFrame:
    """Streamer targets with typed columns."""
    return read_table(spark, path, "streamer_targets", TARGETS, **options)


def vods(spark: SparkSession, path: str, **options) -> DataFrame:
    """Harvested recordings with typed columns; an unknown state is DISCOVERED, missing metadata an empty map."""
    from pyspark.sql import functions as F

    rows = read_table(spark, path, "harvested_vods", VODS, **options)
    known = F.when(F.col("status").isin(*STATES), F.col("status")).otherwise(F.lit(STATES[0]))
    return rows.withColumns({"status": known, "raw_metadata": F.coalesce("raw_metadata", F.create_map().cast("map<string,string>"))})
