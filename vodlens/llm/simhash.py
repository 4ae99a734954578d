"""SimHash near-dedup: segment-popcount embedding, grid range join, exact verification.

A fingerprint's 64 bits fall into 32 segments of two bits; the vector of their bit counts (each 0,
1 or 2) embeds it so that the Manhattan distance of two vectors never exceeds the Hamming distance
of the fingerprints. A count is kept in unary, two bits each: then the Manhattan distance is itself
the number of differing bits of two such codes, and the whole embedding is one 64-bit number.

Grid range join: the 32 coordinates form d + w bands. Vectors at a Manhattan distance of at most d
differ in at most d bands, so they share at least w whole ones: they meet in at least one cell of the
grid over w bands. w is chosen from the counted fingerprints, so that cells stay small as they grow in
number; any w finds all links. In a cell, pairs pass the Manhattan bound and then
the exact Hamming test. A cell gives up only a spanning forest of its links, never all pairs, and
cells of over CELL fingerprints are worked on as pairs of blocks of half that size, so that no task
holds a whole hot cell and no link is lost.

Equal fingerprints are one node throughout: copies cost no pairs.

Defined results: a null text counts as empty, its fingerprint is zero and links like any other;
repeated rows share a component; a null doc_id keeps its row, is never a component's id unless the
component has no other, and an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.llm.common import drop_stored, stored
from vodlens.llm.components import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
CELL = 4_096
#: Whole bands that a cell fixes: the least, the most, and the bits of a vector of unrelated texts' counts.
LEAST_BANDS, MOST_BANDS, ENTROPY = 3, 6, 48
#: Every second bit of a 64-bit number.
EVEN = 0x5555555555555555


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each shingle of a text, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def text_fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of one text, as a signed 64-bit number."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [text_fingerprint(x.as_py() or "", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def unary_counts(fp: Column) -> Column:
    """The embedding: each two-bit segment's bit count in unary."""
    low = F.lit(EVEN)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def bands_of(bands: int) -> list[int]:
    """The bits of each band, as masks over the 32 coordinates of two bits."""
    edges = [round(k * 32 / bands) for k in range(bands + 1)]
    return [((1 << 2 * b) - (1 << 2 * a)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(a: np.ndarray, b: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a, or of those between a and b, by index pairs."""
    both = a if b is None else np.concatenate([a, b])
    root = list(range(len(both)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    low = np.uint64(EVEN)
    even, odd = both & low, both >> np.uint64(1) & low
    code = even | odd | (even & odd) << np.uint64(1)
    out: list[tuple[int, int]] = []
    cut = len(a)
    for i in range(cut):
        start = i + 1 if b is None else cut
        near = np.flatnonzero(np.bitwise_count(code[start:] ^ code[i]) <= distance) + start  # Manhattan bound
        for j in near[np.bitwise_count(both[near] ^ both[i]) <= distance].tolist():
            x, y = find(i), find(j)
            if x != y:
                root[x] = y
                out.append((i, j))
    return out


def bands_for(count: int, distance: int) -> int:
    """The fewest whole bands with which a fingerprint meets at most eight unrelated ones in all its cells."""
    for whole in range(LEAST_BANDS, MOST_BANDS):
        if comb(distance + whole, whole) * count <= 8 * 2 ** (ENTROPY * whole / (distance + whole)):
            return whole
    return MOST_BANDS


def links(nodes: DataFrame, distance: int = DISTANCE, cell: int = CELL, whole: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect what is connected."""
    whole = whole or bands_for(nodes.count(), distance)
    masks = bands_of(distance + whole)
    grids = list(combinations(range(len(masks)), whole))
    code = unary_counts(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(k).alias("grid"), code.bitwiseAND(F.lit(_signed(sum(masks[m] for m in g)))).alias("at")) for k, g in enumerate(grids)])
    placed = nodes.select("fp", F.explode(cells).alias("c")).select("fp", "c.grid", "c.at")
    sizes = placed.groupBy("grid", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    half = cell // 2
    shared = placed.join(sizes, ["grid", "at"]).withColumn("blocks", F.when(F.col("n") <= cell, 1).otherwise(F.ceil(F.col("n") / half)).cast("int"))
    # A fingerprint goes to each pair of blocks that its own block is in; one block: to that alone.
    own = F.pmod(F.xxhash64("fp", "grid"), F.col("blocks")).cast("int")
    shared = shared.withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = shared.select("fp", "grid", "at", "own", other)
    paired = paired.select("fp", "grid", "at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    tasks = paired.groupBy("grid", "at", "i", "j").agg(F.collect_list(F.when(~F.col("second"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("second"), F.col("fp"))).alias("right"))
    tasks = tasks.where((F.size("left") > 0) & (F.size("left") + F.size("right") > 1)).select("i", "j", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out = [], []
            for i, j, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                a = np.array(left, np.int64).view(np.uint64)
                b = None if i == j else np.array(right, np.int64).view(np.uint64)
                if b is not None and not len(b):
                    continue
                both = left if b is None else left + right
                for x, y in spanning_links(a, b, distance):
                    a_out.append(both[x])
                    b_out.append(both[y])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    marked = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    found = stored(links(nodes.select("fp"), distance, cell), "fingerprint-links")
    joined = components(found)
    # Roots are fingerprints; a component's id is the smallest doc_id among its fingerprints.
    member = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = stored(member.join(ids, "root").select("fp", "component_id"), "fingerprint-components")
    drop_stored(found)
    drop_stored(nodes)
    return marked.join(lookup, "fp").select("doc_id", "fp", "component_id")


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id."""
    return near_duplicates(docs, shingle, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs, one for each component in found (doc_id, component_id): the one of its smallest doc_id.

    Rows that repeat that doc_id count as copies too: one of equal rows stays, the one whose text has
    the smallest hash where the texts differ.
    """
    # A null doc_id stands as the smallest long here, so that join and window share one exchange.
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("k_id")).distinct()
    rows = docs.withColumn("k_id", key).join(keep, "k_id")
    order = Window.partitionBy("k_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns))
    return rows.withColumn("k_rank", F.row_number().over(order)).where("k_rank = 1").select(*docs.columns)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, one for each component (see keep_one)."""
    return keep_one(docs, near_duplicates(docs.select("doc_id", "text"), shingle, distance))
