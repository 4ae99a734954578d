"""A stored inverted-list index for similarity search: coarse centroids, lists as partitions, probes, exact re-rank.

Building: coarse centroids are fitted to a bounded sample of the unit vectors (SAMPLE rows at most and
SAMPLE_BYTES of numbers), spherical k-means. Every row of the table then goes to the list of its nearest
centroid, with its distance to it. Lists are the partitions of a Parquet table, so that a search reads
no others; a list of many rows is dealt over several files by a hash.

Searching: queries are taken in blocks. For a block the nearest lists of each query are scanned (the
other lists are pruned before they are opened) and every vector in them gets its exact similarity. That
is the answer of the usual approximate search, with its recall. With exact=True a second scan reads the
lists that may still hold a better one: by the triangle inequality no vector of a list with radius r is
nearer to a query than its distance to the centroid less r. What the second scan adds makes the answer
that of a full scan.

Similarities are cosines, rounded to DIGITS before they are ranked, so that equal vectors are equal in
every task; ties go to the smaller id. Vectors that are null, or hold a null or a component that is not
finite, or are of another length than the longest, are not in the index; a zero vector has similarity 0
to all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vodlens.functions import columns as C
from vodlens.plans.session import shared_folder, ship_package

SAMPLE, SAMPLE_BYTES, MOST_LISTS, ROUNDS = 20_000, 64_000_000, 4_096, 10
BLOCK, FILE_ROWS, DIGITS, MARGIN = 1_024, 500_000, 9, 1e-6


def usable(vectors: DataFrame, item: str, vec: str, *more: str) -> DataFrame:
    """item, vec (unit length, doubles) and more columns of the rows that can be searched."""
    v = F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(item).isNotNull() & F.col(vec).isNotNull()).where(finite)
    return rows.select(F.col(item).cast("long").alias("item"), C.normalised(v).alias("vec"), *more)


def coarse(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors: farthest-first starts, then spherical k-means; empty ones keep their place."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(lists, len(sample)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    out = sample[chosen].copy()
    for _ in range(rounds):
        own = (sample @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1))
        out[size > 0] = sums[size > 0] / size[size > 0, None]
    return out


@dataclass
class Index:
    """Where an index lies, and its centroids (a few thousand vectors at most)."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    schema: T.StructType

    def rows(self) -> DataFrame:
        """list, item, vec, dist and the columns that were kept."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/lists")

    def bounds(self) -> dict[int, tuple[float, float, int]]:
        """Of each list that has rows: the smallest and the largest distance to its centroid, and the number of rows."""
        found = self.rows().groupBy("list").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        return {r.list: (r.low, r.high, r.n) for r in found}


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with list and dist, the distance to the nearest centroid."""
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    at = rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1)
            near = x @ c.T
            own = near.argmax(1)
            dist = np.sqrt(np.maximum(0, (x * x).sum(1) + 1 - 2 * near[np.arange(len(x)), own]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(dist)], [*batch.schema.names, "list", "dist"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, list int, dist double")


def build(vectors: DataFrame, item: str, vec: str, path: str | None = None, lists: int | None = None, keep: list[str] | None = None, sample: int = SAMPLE) -> Index:
    """An index of all vectors; keep: columns that searches can filter by."""
    spark = vectors.sparkSession
    rows = usable(vectors, item, vec, *(keep or []))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = size.n, size.dim or 1
    rows = rows.where(F.size("vec") == dim)
    most = max(1, min(sample, SAMPLE_BYTES // (8 * max(1, dim))))
    share = min(1.0, 1.2 * most / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("item", "vec"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec").limit(most).collect()
    held = np.array(sorted(r.vec for r in drawn if any(r.vec)), float).reshape(-1, dim)
    centroids = coarse(held, min(MOST_LISTS, lists or max(1, round(n**0.5)))) if len(held) else np.zeros((1, dim))
    placed = assigned(rows, centroids)
    index = Index(spark, path or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", centroids, placed.schema)
    placed.limit(0).write.parquet(f"{index.path}/schema")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{index.path}/centroids")
    _append(index, placed)
    return index


def _append(index: Index, placed: DataFrame) -> None:
    """Writes rows into their lists; the files of a large list are as many as its rows need."""
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("files"))
    dealt = placed.join(F.broadcast(sizes), "list").withColumn("deal", F.pmod(F.xxhash64("item"), F.col("files")))  # a row for each list
    dealt.repartition("list", "deal").drop("files", "deal").sortWithinPartitions("list", "dist").write.mode("append").partitionBy("list").parquet(f"{index.path}/lists")


def add(index: Index, vectors: DataFrame, item: str, vec: str, keep: list[str] | None = None) -> None:
    """More rows for an index; its centroids stay as they are."""
    rows = usable(vectors, item, vec, *(keep or []))
    _append(index, assigned(rows.where(F.size("vec") == index.centroids.shape[1]), index.centroids))


def load(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return Index(spark, path, np.array([r.centroid for r in rows], float), spark.read.parquet(f"{path}/schema").schema)


FOUND = "query_id long, item long, sim double"


def scanned(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, k: int, floors: np.ndarray | None = None, not_self: bool = False) -> DataFrame:
    """The k best of each query in the lists that it wants (queries x lists): at most k rows for each query and task."""
    lists = np.flatnonzero(wanted.any(0)).tolist()
    sent = rows.sparkSession.sparkContext.broadcast((ids, queries, wanted, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, want, least = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            of, items = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            for n in np.unique(of).tolist():
                at, mine = np.flatnonzero(of == n), np.flatnonzero(want[:, n])
                sim = np.round(q[mine] @ x[at].T, DIGITS)
                if least is not None:
                    sim = np.where(sim < least[mine, None], -np.inf, sim)
                for row, j in enumerate(mine.tolist()):
                    good = np.isfinite(sim[row]) & ~(not_self & (items[at] == q_ids[j]))
                    s, i = sim[row][good], items[at][good]
                    if j in best:
                        s, i = np.concatenate([best[j][0], s]), np.concatenate([best[j][1], i])
                    order = np.lexsort((i, -s))[:k]
                    best[j] = s[order], i[order]
        for j, (s, i) in best.items():
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array([q_ids[j]] * len(s), pa.int64()), pa.array(i), pa.array(s)], ["query_id", "item", "sim"])

    return rows.where(F.col("list").isin(lists)).select("list", "item", "vec").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "item", "sim")


def probes_of(distance: np.ndarray, probes: int) -> np.ndarray:
    """queries x lists: whether a list is among a query's nearest."""
    out = np.zeros(distance.shape, bool)
    near = np.argsort(distance, axis=1, kind="stable")[:, :probes]
    out[np.arange(len(distance))[:, None], near] = True
    return out


def search(index: Index, queries: DataFrame, item: str, vec: str, k: int = 10, probes: int = 8, exact: bool = False, not_self: bool = False, where: Column | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, item, sim: the k most similar rows of each query (one vector per id) among those that fit `where`."""
    spark = index.spark
    ship_package(spark)
    asked = usable(queries, item, vec).where(F.size("vec") == index.centroids.shape[1]).groupBy(F.col("item").alias("query_id")).agg(F.min("vec").alias("vec"))
    blocks = max(1, -(-asked.count() // block))
    rows = index.rows() if where is None else index.rows().where(where)
    limits, out = index.bounds() if exact else {}, None
    for b in range(blocks):
        mine = sorted(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect(), key=lambda r: r.query_id)
        if not mine:
            continue
        ids, q = np.array([r.query_id for r in mine], np.int64), np.array([r.vec for r in mine], float)
        distance = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (index.centroids**2).sum(1) - 2 * q @ index.centroids.T))
        first = probes_of(distance, probes)
        found = scanned(rows, ids, q, first, k, not_self=not_self)
        if exact:
            folder = f"{shared_folder(spark)}/probed-{uuid.uuid4().hex}"
            ranked(found, k).write.parquet(folder)
            found = spark.read.parquet(folder).select("query_id", "item", "sim")
            kth = {r.query_id: r.sim for r in found.groupBy("query_id").agg(F.min("sim").alias("sim"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
            floors = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
            # A zero vector is at distance 1 from every unit vector and has similarity 0, not 1/2: its bound is 0.
            least = np.full(distance.shape, np.inf)
            for n, (low, high, _) in limits.items():
                least[:, n] = np.maximum(0, np.maximum(distance[:, n] - high, low - distance[:, n]) - MARGIN)
            most = np.maximum(1 - least**2 / 2, 0.0) + MARGIN
            second = ~first & np.isfinite(least) & (most >= floors[:, None])
            if second.any():
                found = found.unionByName(scanned(rows, ids, q, second, k, floors, not_self))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, item long, sim double")
    return ranked(out, k)
