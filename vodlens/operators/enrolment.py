"""Voiceprint enrolment: an ordered fold of embeddings into one centroid per creator, over many tasks.

The first sample is the centroid; each later one gives (n * centroid + sample) / (n + 1), scaled to unit
length. That is not a mean: the scaling makes every step depend on all before it. But with the lengths
that the steps divide by held fixed, a block of samples is an affine map of the centroid that comes in
(a number times it, plus a vector), and such maps are composed in order. So:

1. The samples of a creator are cut into ordered blocks; every block is folded from a guess of its
   incoming centroid and gives its end, its number and its vector.
2. The maps of a creator's blocks are composed in order, which gives every block a better guess.
3. Until no incoming centroid moves by more than TOLERANCE: then each block's fold has begun where the
   one before it ended, and the last end is that of the sequential fold. Each pass makes at least one
   more block exact, so it always ends; a few passes are usual.

A task holds one block; a creator's block maps (two vectors each) meet in one task.

Defined results: samples that are null, or hold a null or a component that is not finite, take no part;
a sum of length zero stays zero, as a zero centroid; ties in the order go by the vector itself.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vodlens.operators import blocks
from vodlens.plans.session import shared_folder, ship_package

TOLERANCE, MOST_PASSES = 1e-13, 10_000


def folded(centroid: np.ndarray | None, n: int, samples: np.ndarray) -> tuple[np.ndarray, float]:
    """The centroid after some samples, and how much of the incoming one is in it, with the lengths held fixed."""
    share = 1.0
    for x in samples:
        if centroid is None:
            centroid, share = x.copy(), 0.0
        else:
            total = (n * centroid + x) / (n + 1)
            size = float(np.sqrt(total @ total))
            centroid = total / size if size > 0 else total
            share *= n / (n + 1) / (size if size > 0 else 1.0)
        n += 1
    return centroid, share


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ends(samples: DataFrame, guesses: DataFrame, key: str) -> DataFrame:
    """Each block folded from its guess: its end, the share of the incoming centroid and the rest."""
    schema = samples.select(key, "block").schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(of: tuple, own: pa.Table, guess: pa.Table) -> pa.Table:
        x = own.sort_by("place").column("vec").combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1)
        row = guess.slice(0, 1).to_pylist()[0]
        start = None if row["start"] is None else np.array(row["start"])
        end, share = folded(start, row["n"], x)
        rest = end if start is None else end - share * start
        cells = {key: own.column(key)[:1], "block": own.column("block")[:1], "share": [share], "rest": [rest.tolist()], "after": [end.tolist()]}
        return pa.table({k: pa.chunked_array(v) if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in cells.items()})

    return samples.groupBy(key, "block").cogroup(guesses.groupBy(key, "block")).applyInArrow(run, f"{kinds}, share double, rest array<double>, after array<double>")


def _composed(ends: DataFrame, guesses: DataFrame, key: str) -> DataFrame:
    """New guesses from the maps of a key's blocks in order, and how far each has moved."""
    both = ends.join(guesses.withColumnRenamed("start", "old"), [key, "block"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in guesses.schema)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        centroid, starts, moved = None, [], []
        for r in rows:
            starts.append(None if centroid is None else centroid.tolist())
            old = None if r["old"] is None else np.array(r["old"])
            moved.append(0.0 if centroid is None else float(np.abs(centroid - old).max()))
            if centroid is None or (old is not None and moved[-1] == 0.0):
                centroid = np.array(r["after"])
            else:
                centroid = r["share"] * centroid + np.array(r["rest"])
                size = float(np.sqrt(centroid @ centroid))
                centroid = centroid / size if size > 0 else centroid
        table = table.sort_by("block")
        return pa.table({key: table.column(key), "block": table.column("block"), "n": table.column("n"), "start": pa.array(starts, pa.list_(pa.float64())), "moved": pa.array(moved)})

    return both.groupBy(key).applyInArrow(run, f"{kinds}, moved double")


def enrol(rows: DataFrame, key: str, order: list[str], vec: str, rows_per_block: int = blocks.ROWS_PER_BLOCK) -> DataFrame:
    """key, sample_count and centroid of each creator, by folding its samples in order."""
    spark = rows.sparkSession
    ship_package(spark)
    v = F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = rows.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).where(finite).select(F.col(key), *[c for c in order if c != key], v.alias("vec"))
    sorted_rows = blocks.in_blocks(held, [key], [*order, "vec"], rows_per_block).withColumn("place", F.monotonically_increasing_id()).select(key, "block", "place", "vec")
    samples = _written(sorted_rows, "samples")
    sizes = samples.groupBy(key, "block").agg(F.count(F.lit(1)).alias("m"), F.min_by("vec", "place").alias("first"))
    before = Window.partitionBy(key).orderBy("block")
    n = F.coalesce(F.sum("m").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The first guess of every block but a key's first is the key's first sample, at unit length.
    size = F.sqrt(F.aggregate(F.first("first").over(before), F.lit(0.0), lambda a, x: a + x * x))
    guesses = _written(sizes.select(key, "block", n.alias("n"), F.when(n > 0, F.transform(F.first("first").over(before), lambda x: x / F.when(size > 0, size).otherwise(1.0))).alias("start")), "guesses")
    for _ in range(MOST_PASSES):
        ends = _written(_ends(samples, guesses, key), "ends")
        found = _written(_composed(ends, guesses, key), "guesses")
        moved = found.agg(F.max("moved").alias("m")).first().m
        guesses = found.drop("moved")
        if moved is None or moved <= TOLERANCE:
            break
    last = ends.join(samples.groupBy(key, "block").agg(F.count(F.lit(1)).alias("m")), [key, "block"])
    return last.groupBy(key).agg(F.sum("m").alias("sample_count"), F.max_by("after", "block").alias("centroid"))
