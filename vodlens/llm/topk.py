"""Exact top-k search: pivot-table elimination.

Components become floor(256 * x). A few dozen pivots are chosen from a bounded sample, each far from
the others, and a table with every vector's distances to all pivots is computed once and stored. For a
query q and a candidate x the triangle inequality gives max |d(q,p) - d(x,p)| as a lower bound of their
distance, hence (|q|^2 + |x|^2 - bound^2) / 2 as an upper bound of their inner product, with a margin
for rounding. A task takes its candidates in the order of their bounds and stops exactly: when the next
bound is below the k-th best score found, or below that among the sample, which any vector of the true
result reaches. Scores are exact integers: 64-bit where the components allow it, wider ones elsewhere.

Queries are a stated set. One block of them is broadcast (its size is checked); more are dealt in one job.
Then the candidates are cut into groups by range: by their nearest pivot and the distance to it. Of each
group the smallest and largest distance to every pivot and the largest square are known, which bounds
the inner product of a query with all of the group at once, and a query is sent only to groups whose bound
reaches its threshold. A task holds a group's candidates, its queries stream past in blocks of BLOCK, and
each block gives up at most k rows per query. The driver sees the sample and a few numbers per group (of
which there are MOST_GROUPS at most, GROUP candidates each or more).

Sample: at most SAMPLE vectors, to place the pivots and for first thresholds; any give the same results.

Defined results: vectors that are null, or hold a null or a component that is not finite, and rows
without vec_id take no part; a query has only candidates of its own length, never rows of its own
vec_id; ties go to the smaller vec_id; a score that no 64-bit integer holds keeps its exact rank and is
null; repeated rows count each as a candidate and, as queries, give one result; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vodlens.llm.common import drop_stored, partitions, stored

PIVOTS, SAMPLE, BLOCK, GROUP, FIRST, MOST_GROUPS = 32, 1_024, 1_024, 16_384, 64, 16_384
SCALE = 256
TABLE = "vec_id long, dim int, raw binary, dist binary"
SUMMARY = "g int, dim int, low binary, high binary, square double"
FOUND = "query_id long, q string, vec_id long, score long, side int, digits string"
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scores beyond 64 bits travel as text of one width, shifted to be positive, so that texts sort like numbers.
SHIFT, WIDTH = 10**700, 701


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def whole(raw: np.ndarray) -> np.ndarray:
    """floor(256 * x) as doubles, exact up to overflow."""
    with np.errstate(over="ignore"):
        return np.floor(raw * SCALE)


def wide(raw: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python integers of any size."""
    return np.array([int(x) * SCALE if abs(x) > 1e300 else int(np.floor(x * SCALE)) for x in raw.tolist()], object)


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots by farthest-first traversal."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], axis=1)


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, dim, raw (packed doubles) and dist (packed distances to the pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in by_length(batch.column(0), batch.column(1)):
                dist = distances(whole(raw), pivots[raw.shape[1]]) if raw.shape[1] in pivots else np.zeros((len(raw), 0))
                cols = [pa.array(ids), pa.array([raw.shape[1]] * len(raw), pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in dist], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "raw", "dist"])

    return vectors.mapInArrow(run, TABLE)


def by_length(ids: pa.Array, vecs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.diff(vecs.offsets.to_numpy())
    flat, starts, ids = vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()[:-1], ids.to_numpy()
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield ids[at], flat[starts[at, None] + np.arange(n)].astype(np.float64)


class Vectors:
    """Rows of the pivot table that have one length: 64-bit integers where no sum of products can overflow."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, dist: np.ndarray):
        self.ids, self.raw, self.dist = ids, raw, dist
        x = whole(raw)
        most = np.abs(x).max(1, initial=0.0)
        with np.errstate(over="ignore"):
            self.narrow = most * most * max(1, raw.shape[1]) < 2.0**62
        self.x = np.where(self.narrow[:, None], x, 0).astype(np.int64)
        with np.errstate(over="ignore"):
            self.square = (x * x).sum(1)

    @classmethod
    def of(cls, rows: list[tuple[int, bytes, bytes]], dim: int) -> Vectors:
        unpacked = lambda k, width: np.frombuffer(b"".join(r[k] for r in rows), np.float64).reshape(len(rows), width)
        return cls(np.array([r[0] for r in rows], np.int64), unpacked(1, dim), unpacked(2, len(rows[0][2]) // 8))

    def bounds(self, square: float, dist: np.ndarray) -> np.ndarray:
        """At least every inner product with a query of that square and those distances."""
        with np.errstate(over="ignore", invalid="ignore"):
            low = np.abs(self.dist - dist).max(1, initial=0.0) * (1 - 1e-9)
            total = self.square + square
            out = (total - np.maximum(low * low, 0)) / 2 + 1e-9 * total + 1
        return np.where(np.isnan(out), np.inf, out)

    def products(self, at: np.ndarray, query: np.ndarray, narrow: bool, raw: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Exact inner products: of 64 bits, with the places (in at) that need more, as Python integers in their order."""
        some = self.narrow[at] & narrow
        score = self.x[at] @ query
        return np.where(some, score, 0), np.flatnonzero(~some).tolist()


class Best:
    """The k best of one query: 64-bit scores as arrays, wider ones as a list."""

    def __init__(self, k: int, floor: float = -np.inf):
        self.k, self.floor = k, floor
        self.score, self.ids, self.wide = np.empty(0, np.int64), np.empty(0, np.int64), []

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, ~score))[: self.k]
        self.score, self.ids = score[order], ids[order]

    def add_wide(self, score: int, vec_id: int) -> None:
        if LEAST <= score <= MOST:
            self.add(np.array([score]), np.array([vec_id]))
        else:
            self.wide = sorted([*self.wide, (score, vec_id)], key=lambda e: (-e[0], e[1]))[: self.k]

    def least(self) -> float:
        return max(self.floor, float(self.score[-1])) if len(self.score) == self.k else self.floor


def eliminate(best: Best, query: tuple[int, np.ndarray, np.ndarray, bool, np.ndarray, float], rows: Vectors) -> int:
    """Evaluates a query's candidates in the order of their bounds until none can enter; returns how many it took."""
    own, x, raw, narrow, dist, square = query
    bound = rows.bounds(square, dist)
    size, taken = FIRST, 0
    left = np.flatnonzero((rows.ids != own) & (bound >= best.least()))
    while len(left):
        if len(left) > size:
            split = np.argpartition(-bound[left], size)
            now, left = left[split[:size]], left[split[size:]]
        else:
            now, left = left, left[:0]
        score, rest = rows.products(now, x, narrow, raw)
        mine = np.ones(len(now), bool)
        mine[rest] = False
        best.add(score[mine], rows.ids[now[mine]])
        for k in now[rest].tolist():
            best.add_wide(int((wide(rows.raw[k]) * wide(raw)).sum()), int(rows.ids[k]))
        taken += len(now)
        left = left[bound[left] >= best.least()]
        size *= 4
    return taken


class Queries:
    """A block of queries of one length, with thresholds from the sample."""

    def __init__(self, rows: Vectors, k: int, sample: Vectors | None):
        self.rows, self.best = rows, [Best(k) for _ in rows.ids]
        if sample is not None and sample.narrow.all() and len(sample.ids) > k:
            score = np.where(sample.ids[:, None] == rows.ids, LEAST, sample.x @ rows.x.T)
            kth = np.partition(score, len(sample.ids) - k, axis=0)[len(sample.ids) - k]
            for j in np.flatnonzero(rows.narrow & (kth > LEAST)).tolist():
                self.best[j].floor = float(kth[j]) - abs(float(kth[j])) * 1e-12

    def meet(self, candidates: Vectors) -> int:
        r = self.rows
        return sum(eliminate(best, (int(r.ids[j]), r.x[j], r.raw[j], bool(r.narrow[j]), r.dist[j], float(r.square[j])), candidates) for j, best in enumerate(self.best))

    def found(self) -> list[tuple]:
        out = []
        for j, best in enumerate(self.best):
            own, name = int(self.rows.ids[j]), f"{self.rows.ids[j]} {self.rows.raw[j].tobytes().hex()}"
            out += [(own, name, i, s, 0, None) for s, i in zip(best.score.tolist(), best.ids.tolist())]
            out += [(own, name, i, None, 1 if s > 0 else -1, f"{s + SHIFT:0{WIDTH}d}") for s, i in best.wide]
        return out


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split(" ")[0] for c in FOUND.split(", ")])


def grouped_by_length(rows: list[tuple]) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for vec_id, dim, raw, dist in rows:
        out.setdefault(dim, []).append((vec_id, raw, dist))
    return out


def _broadcast_block(table: DataFrame, queries: list[tuple], sample: dict[int, Vectors], k: int) -> DataFrame:
    """The queries fit one block: they are sent to the candidates."""
    sent = table.sparkSession.sparkContext.broadcast((queries, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, samples = sent.value
        blocks = {n: Queries(Vectors.of(rows, n), k, samples.get(n)) for n, rows in grouped_by_length(asked).items()}
        for batch in batches:
            for n, rows in grouped_by_length(list(zip(*(c.to_pylist() for c in batch.columns)))).items():
                if n in blocks:
                    blocks[n].meet(Vectors.of(rows, n))
        yield found_batch([r for b in blocks.values() for r in b.found()])

    return table.mapInArrow(run, FOUND)


def _ranged(table: DataFrame, groups: int) -> DataFrame:
    """g, the group, and the columns of the table: groups are ranges of nearest pivot and distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = [], []
            for raw in batch.column(3):
                dist = np.frombuffer(raw.as_py(), np.float64)
                dist = np.where(np.isnan(dist), np.inf, dist)
                near.append(int(dist.argmin()) if len(dist) else -1)
                far.append(float(dist.min()) if len(dist) else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(far), *batch.columns], ["near", "far", *batch.schema.names])

    placed = table.mapInArrow(run, f"near int, far double, {TABLE}")
    dealt = placed.repartitionByRange(groups, "dim", "near", "far", "vec_id", "raw")
    return dealt.select(F.spark_partition_id().alias("g"), *table.columns)


def _summaries(table: DataFrame) -> DataFrame:
    """Of each group and length: the least and the largest distance to each pivot, and the largest square; a row for each task that holds some of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list] = {}
        for batch in batches:
            for g, rows in _by_group(batch):
                for n, of_length in grouped_by_length(rows).items():
                    v = Vectors.of(of_length, n)
                    dist = np.where(np.isnan(v.dist), np.inf, v.dist)
                    low, high = dist.min(0), dist.max(0)
                    # Wide vectors are never ruled out.
                    square = float(v.square.max()) if v.narrow.all() else np.inf
                    old = seen.get((g, n))
                    seen[g, n] = [low, high, square] if old is None else [np.minimum(old[0], low), np.maximum(old[1], high), max(old[2], square)]
        if seen:
            cells = zip(*[(g, n, low.tobytes(), high.tobytes(), square) for (g, n), (low, high, square) in seen.items()])
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], [c.split(" ")[0] for c in SUMMARY.split(", ")])

    return table.mapInArrow(run, SUMMARY)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple]]]:
    out: dict[int, list[tuple]] = {}
    for g, *row in zip(*(c.to_pylist() for c in batch.columns)):
        out.setdefault(g, []).append(tuple(row))
    yield from out.items()


class Routes:
    """Which groups a query has to visit."""

    def __init__(self, summaries: list[tuple]):
        seen: dict[tuple[int, int], list] = {}
        for g, n, low, high, square in summaries:
            low, high = np.frombuffer(low, np.float64), np.frombuffer(high, np.float64)
            old = seen.get((g, n))
            seen[g, n] = [low, high, square] if old is None else [np.minimum(old[0], low), np.maximum(old[1], high), max(old[2], square)]
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {n for _, n in seen}:
            own = sorted(g for g, m in seen if m == n)
            parts = [seen[g, n] for g in own]
            self.of[n] = (np.array(own), np.stack([p[0] for p in parts]), np.stack([p[1] for p in parts]), np.array([p[2] for p in parts]))

    def groups(self, n: int, square: float, dist: np.ndarray, floor: float) -> np.ndarray:
        """The groups whose bound reaches the floor."""
        if n not in self.of:
            return np.empty(0, np.int64)
        own, low, high, largest = self.of[n]
        with np.errstate(invalid="ignore", over="ignore"):
            apart = np.maximum(np.maximum(low - dist, dist - high).max(1, initial=0.0), 0) * (1 - 1e-9)
            total = largest + square
            bound = (total - apart * apart) / 2 + 1e-9 * total + 1
        return own[~(bound < floor)]


def _dealt_blocks(table: DataFrame, asked: DataFrame, sample: dict[int, Vectors], k: int, block: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Every group of candidates meets the queries that it may answer, which stream past in blocks. Gives also the stored groups."""
    spark = table.sparkSession
    groups = max(1, min(MOST_GROUPS, -(-table.count() // group)))
    ranged = stored(_ranged(table, groups), "pivot-groups")
    routes = Routes([tuple(r) for r in _summaries(ranged).collect()])  # a few numbers for each group and task
    sent = spark.sparkContext.broadcast(sample)
    known = spark.sparkContext.broadcast(routes)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for n, rows in grouped_by_length(list(zip(*(c.to_pylist() for c in batch.columns)))).items():
                queries = Queries(Vectors.of(rows, n), k, sent.value.get(n))
                for j, row in enumerate(rows):
                    r = queries.rows
                    square = float(r.square[j]) if r.narrow[j] else np.inf
                    out += [(int(g), row[0], n, row[1], row[2]) for g in known.value.groups(n, square, r.dist[j], queries.best[j].floor)]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000]), kinds)], ["g", "vec_id", "dim", "raw", "dist"])

    mine = ranged.select("g", F.lit(0).alias("kind"), *table.columns)
    theirs = asked.mapInArrow(routed, f"g int, {TABLE}").select("g", F.lit(1).alias("kind"), *table.columns)
    places = min(groups, max(partitions(spark), 10_000))
    dealt = mine.unionByName(theirs).repartitionById(places, F.pmod("g", F.lit(places))).sortWithinPartitions("g", "kind", "dim", "vec_id", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, candidates, waiting = None, [], {}, []

        def answer() -> Iterator[pa.RecordBatch]:
            for n, rows in grouped_by_length(waiting).items():
                if n in candidates:
                    queries = Queries(Vectors.of(rows, n), k, sent.value.get(n))
                    queries.meet(candidates[n])
                    yield found_batch(queries.found())
            waiting.clear()

        for batch in batches:
            for g, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now:
                    yield from answer()
                    now, held, candidates = g, [], None
                if kind == 0:
                    held.append(row)
                    continue
                if candidates is None:
                    candidates = {n: Vectors.of(rows, n) for n, rows in grouped_by_length(held).items()}
                    held = []
                waiting.append(row)
                if len(waiting) >= block:
                    yield from answer()
        yield from answer()

    return dealt.select("g", "kind", *table.columns).mapInArrow(run, FOUND), ranged


def search(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, group: int = GROUP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query (vec_id divisible by `every`)."""
    rows = usable(vectors, id_col, vec_col)
    placed = [(r.vec_id, len(r.vec), np.array(r.vec, np.float64).tobytes(), b"") for r in rows.orderBy(F.xxhash64("vec_id", "vec")).limit(sample).collect()]
    samples = {n: Vectors.of(of_length, n) for n, of_length in grouped_by_length(placed).items() if n}
    with np.errstate(over="ignore", invalid="ignore"):
        chosen = {n: far_apart(whole(v.raw[v.narrow]), pivots) for n, v in samples.items() if v.narrow.any()}
    table = stored(pivot_table(rows, chosen), "pivot-table")
    asked = table.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "raw"])
    first, ranged = asked.limit(block + 1).collect(), None
    if len(first) <= block:
        found = _broadcast_block(table, [(r.vec_id, r.dim, bytes(r.raw), bytes(r.dist)) for r in first], samples, k)
    else:
        found, ranged = _dealt_blocks(table, asked, samples, k, block, group)
    # Of repeated rows as candidates each counts; as queries they are one, named by id and vector.
    order = Window.partitionBy("q").orderBy(F.desc("side"), F.desc("score"), F.desc("digits"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = stored(top.select("query_id", "rank", "vec_id", "score"), "top-k")
    drop_stored(table)
    if ranged is not None:
        drop_stored(ranged)
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
WHERE rank <= 5
"""
