"""Helpers that the corpus operators share: table reading, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vodlens.plans.session import ship_package

#: ASCII white space `[\x20\x09-\x0D]`, the only white space that the operators strip or split at.
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables, read by Spark's own reader whatever store the path names."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else (lower() would also change other scripts)."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='vodlens-')}"
        sc.setCheckpointDir(root)
        atexit.register(remove, spark, root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_root(spark)}/vodlens/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder in whatever store it is; a missing one is no error."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the folder is temporary anyway
        return


def remove_matching(spark: SparkSession, pattern: str) -> None:
    """Deletes all files of a glob pattern in whatever store it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    for found in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target) or ():
        remove(spark, found.getPath().toString())


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes within remove their shuffle files as soon as they are done: nothing reads those again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage.

    Unlike localCheckpoint the files outlive any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_freed(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt to as many partitions by its keys as stored_sorted() has buckets."""
    return df.repartition(partitions(df.sparkSession), *keys)


def stored_sorted(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Like stored(), for a table that is dealt() by the keys, sorted by them: joins of such tables on the keys move no rows.

    A union has to be of their plain() form: Spark 4.1 takes one of such tables for dealt by its keys,
    although it reads its parts one after another, and leaves equal keys in several groups.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    listed = path.rpartition("/")[2].replace("-", "_")
    with shuffles_freed(spark):
        df.write.bucketBy(partitions(spark), *keys).sortBy(*keys).option("path", path).saveAsTable(listed)
    out = spark.table(listed)
    out.stored_path, out.stored_table = path, listed
    return out


def plain(df: DataFrame) -> DataFrame:
    """The files of a stored_sorted() table, without its buckets."""
    return df.sparkSession.read.schema(df.schema).parquet(df.stored_path)


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a stored() or stored_sorted() table once nothing reads it any more."""
    if listed := getattr(df, "stored_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {listed}")
    if path := getattr(df, "stored_path", None):
        remove(df.sparkSession, path)


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A kernel that gives the memory it no longer uses back to the system when its task ends.

    Workers outlive tasks: what one stage's kernel has used would count against the next one's.
    """

    @wraps(run)
    def ending(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return ending


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
