"""Near copies by exact Jaccard similarity of word shingles: SimHash links first, then a wider search.

A text's set holds its runs of SHINGLE words (the whole text, if it is shorter; words as in
vodlens.llm.simhash). Equal sets are one node. A pair is linked only if the similarity of its whole
sets, computed from the texts, is at least SIMILARITY. Candidates come in three steps:

* the grid range join of vodlens.llm.simhash links fingerprints at a few differing bits;
* these reach few pairs near SIMILARITY (42 of 293 on one table), so each node is also placed in BANDS
  cells, each keyed by ROWS minima of its set's hashes; two sets of similarity s share no cell with
  probability (1 - s ** ROWS) ** BANDS, which is 6e-5 at 0.8 and falls steeply above. Each member of a
  cell is compared with the cell's smallest node, then with one that differs from cell to cell, as
  long as the cell is not yet one component;
* of the cells that still hold several components all pairs are compared, within tasks: a task has one
  block of a cell's sets, or two, counts what they share by matrix products and gives up a spanning
  forest of the links, never all pairs. Blocks are bounded in sets and in shingles, so no task holds a
  whole hot cell and no link is lost.

Defined results: a null text counts as empty, and empty texts are copies of each other; a null doc_id
is never a component's id unless the component has no other; of repeated rows, as of all copies, one stays;
extra columns, of whatever names, stay with their rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.llm import simhash
from vodlens.llm.common import drop_stored, freed, partitions, stored
from vodlens.llm.components import components
from vodlens.llm.simhash import SEED, keep_one, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Most sets and shingles of a block of a cell.
BLOCK_SETS, BLOCK_SHINGLES = 1_024, 1_500_000
#: Sets that a worker keeps at hand while it verifies pairs, and the most shingles of one kept.
HELD, HELD_SIZE = 64, 50_000


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def node_of(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes(), SEED) - (1 << 63)


def cells_of(members: np.ndarray) -> list[int]:
    """The keys of a set's bands; none for the empty set."""
    if not len(members):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(members), 512):  # bounded memory for very long texts
        np.minimum(low, (members[k : k + 512, None] * _FACTORS).min(0), out=low)
    return [xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, marks, cells = [], [], [], []
            for x in batch.column(1):
                hashes = shingle_hashes(x.as_py() or "", shingle)
                members = np.unique(hashes)
                nodes.append(node_of(members))
                sizes.append(len(members))
                marks.append(simhash.fingerprint_of(hashes))
                cells.append(pa.array(cells_of(members), pa.int64()))
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.concat_arrays([*cells, pa.array([], pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.int64()), listed], ["doc_id", "node", "n", "fp", "cells"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, n int, fp long, cells array<long>")


def _with_node(docs: DataFrame, shingle: int) -> DataFrame:
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(shingle_set(x.as_py() or "", shingle)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column(0)], ["node", "text"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, text string")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose sets are similar enough."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def members(node: int, text: pa.Scalar) -> np.ndarray:
            found = held.get(node)
            if found is None:
                found = shingle_set(text.as_py() or "", shingle)
                if len(found) <= HELD_SIZE:
                    if len(held) >= HELD:
                        del held[next(iter(held))]
                    held[node] = found
            return found

        for batch in batches:
            a, b, left, right = batch.columns
            good = [jaccard(members(x, s), members(y, t)) >= similarity for x, y, s, t in zip(a.to_pylist(), b.to_pylist(), left, right)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs of rows (x, x_n, y, y_n) whose sizes allow the similarity."""
    able = F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * F.lit(similarity)
    return rows.where((F.col("x") != F.col("y")) & able).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def _open_cells(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The shared rows, with their roots, of the cells that are not yet one component."""
    roots = stored(components(links), "copies-roots")
    rooted = shared.join(roots.withColumnRenamed("root", "r"), "node", "left").select("node", "n", "cell", F.coalesce("r", "node").alias("root"))
    rooted = stored(rooted, "copies-rooted")
    drop_stored(roots)
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("cell")
    return rooted.join(mixed, "cell")


def shared_counts(sets: list[np.ndarray], width: int = 4_096) -> np.ndarray:
    """How many members each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[at] > 1
    owner, at = owner[common], at[common]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], np.unique(at[order], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        mine = slice(*np.searchsorted(at, (low, low + width)))
        held = np.zeros((len(sets), width), np.float32)
        held[owner[mine], at[mine] - low] = 1
        out += held @ held.T
    return out


def forest(sets: list[np.ndarray], cut: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets, or, where cut is not 0, of those between the first `cut` and the rest."""
    sizes = np.array([len(x) for x in sets], np.float64)
    both = shared_counts(sets).astype(np.float64)
    near = both / (sizes[:, None] + sizes - both) >= similarity
    if cut:
        near[:cut, :cut] = near[cut:, cut:] = False
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        edge = [root] if left[root] else []
        left[root] = False
        while edge:
            x = edge.pop()
            fresh = np.flatnonzero(near[x] & left)
            left[fresh] = False
            out += [(x, y) for y in fresh.tolist()]
            edge += fresh.tolist()
    return out


def _within_cells(open_: DataFrame, texts: DataFrame, shingle: int, similarity: float, block_sets: int, block_shingles: int) -> DataFrame:
    """Links (a, b) among all members (cell, node, n) of the cells, enough to connect what is connected."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("int")
    # Cells of the same members are one.
    alike = open_.groupBy("cell").agg(need.alias("blocks"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
    chosen = alike.groupBy("m", "sum", "blocks").agg(F.min("cell").alias("cell")).select("cell", "blocks")
    placed = open_.join(chosen, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("cell", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("cell", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    keys = ("cell", "i", "j")
    dealt = placed.join(texts, "node").repartition(partitions(open_.sparkSession), *keys).sortWithinPartitions(*keys, "second", "node")

    def finished(nodes: list[int], sets: list[np.ndarray], cut: int, pair: bool) -> pa.RecordBatch:
        links = forest(sets, cut, similarity) if (cut if pair else len(sets) > 1) else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, cut = None, [], [], 0
        for batch in batches:
            for cell, i, j, second, node, text in zip(*batch.columns):
                key = (cell.as_py(), i.as_py(), j.as_py())
                if key != now:
                    if now:
                        yield finished(nodes, sets, cut, now[1] != now[2])
                    now, nodes, sets, cut = key, [], [], 0
                cut += key[1] != key[2] and not second.as_py()
                nodes.append(node.as_py())
                sets.append(shingle_set(text.as_py() or "", shingle))
        if now:
            yield finished(nodes, sets, cut, now[1] != now[2])

    return dealt.select(*keys, "second", "node", "text").mapInArrow(run, "a long, b long")


def _marked_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Candidates of the fingerprints: nodes of one fingerprint, and the first nodes of linked ones."""
    shape = F.struct("node", "n")
    heads = nodes.groupBy("fp").agg(F.min(shape).alias("head"))
    same = nodes.join(heads, "fp").select(F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("head.node").alias("y"), F.col("head.n").alias("y_n"))
    found = simhash.links(heads.select("fp"))
    left, right = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_head")) for k in ("a", "b"))
    across = found.join(left, "a").join(right, "b")
    across = across.select(F.col("a_head.node").alias("x"), F.col("a_head.n").alias("x_n"), F.col("b_head.node").alias("y"), F.col("b_head.n").alias("y_n"))
    return _pairs(same.unionByName(across), similarity)


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) between nodes (node, n, fp, cells), enough to connect what is connected."""
    placed = nodes.select("node", "n", F.explode("cells").alias("cell"))
    shape = F.struct("node", "n")
    heads = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min(shape).alias("head")).where("size > 1")
    shared = stored(placed.join(heads, "cell").select("node", "n", "cell", "head"), "copies-shared")
    marked = stored(_marked_pairs(nodes.where("n > 0"), similarity), "copies-marked-pairs")
    near = shared.select("node").unionByName(marked.select(F.col("a").alias("node"))).union(marked.select("b")).distinct()
    texts = stored(_with_node(docs, shingle).join(near, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "copies-texts")

    def star(rows: DataFrame) -> DataFrame:
        return _pairs(rows.select(F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("head.node").alias("y"), F.col("head.n").alias("y_n")), similarity)

    found = stored(verified(marked, texts, shingle, similarity), "copies-links")
    open_ = stored(_open_cells(shared.select("node", "n", "cell"), found), "copies-open")
    for pick in (F.col("node"), F.xxhash64("node", "cell")):
        head = open_.groupBy("cell").agg(F.min_by(F.struct("node", "n", "root"), pick).alias("head"))
        apart = open_.join(head, "cell").where(F.col("root") != F.col("head.root"))
        more = stored(found.unionByName(verified(star(apart), texts, shingle, similarity)), "copies-links")
        fresh = stored(_open_cells(open_.select("node", "n", "cell"), more), "copies-open")
        drop_stored(found)
        drop_stored(open_)
        found, open_ = more, fresh
    out = stored(found.unionByName(_within_cells(open_, texts, shingle, similarity, block_sets, block_shingles)), "copies-links")
    for done in (found, open_, shared, marked, texts):
        drop_stored(done)
    return out


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of every row."""
    marked = stored(_marked(docs, shingle), "copies-marked")
    nodes = stored(marked.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.min("fp").alias("fp"), F.any_value("cells").alias("cells")), "copies-nodes")
    joined = components(links(docs, nodes, shingle, similarity))
    member = nodes.select("node", "first_id").join(joined, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lookup = stored(member.join(ids, "root").select("node", "component_id"), "copies-components")
    drop_stored(nodes)
    return marked.select("doc_id", "node").join(lookup, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, one for each component: the one of its smallest doc_id."""
    return keep_one(docs, near_copies(docs.select("doc_id", "text"), shingle, similarity))
