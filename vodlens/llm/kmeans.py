"""Centroid clustering: Hamerly's bounds, exact integers.

Components become floor(256 * x). A stored table holds, for every vector, its components, its cluster
and two bounds: an upper one of the distance to its own centroid and a lower one of the distance to the
second-nearest. After each round a bound is loosened by how far the centroids went (the upper one by its
own centroid's way, the lower one by the longest way of the others). A vector whose upper bound is below
its lower bound, or below half the distance from its centroid to the next one, keeps its cluster; where
the upper bound alone is too loose, the exact distance to its own centroid is taken first. All others are
ambiguous: a full exact integer scan of all centroids (ties: smaller number) assigns them anew. Bounds are
floats with a margin for rounding and compared strictly, so ties always get a scan.

A round is one map over the table that the round before has stored, without a shuffle, and one sum by
cluster (combined in the tasks first). The driver sees the centroids, never vectors.

Components too large for sums of squares in 64 bits go through Python's integers of any size: their rows and centroids are
rare by nature and keep their exact results, and sums of them travel as digits of base 2**24.

Defined results: vectors that are null, of another length, or with a null or a component that is not
finite, and rows without vec_id take no part; repeated rows each take part; equal hashes of repeated
vec_ids go by the components; fewer vectors than clusters make fewer clusters, none make no rows;
a squared distance or inertia that no 64-bit integer holds is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vodlens.llm.common import drop_stored, freed, stored

CLUSTERS, ROUNDS, LENGTH, SEED = 40, 5, 64, "2"
SCALE = 256
MARGIN = 1e-9
STATE = "vec_id long, vec array<long>, wide array<double>, cluster int, upper double, lower double, scans int"
#: Sums of components beyond 64 bits: digits of base 2**DIGIT, so that 2**39 rows can be added up.
DIGIT = 24
MOST = (1 << 63) - 1


def narrow_limit(length: int) -> int:
    """The largest component with which no sum of squared differences leaves 62 bits."""
    return math.isqrt((1 << 62) // length) // 2


def usable(vectors: DataFrame, length: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id with vec (integers) or, where these are too large, wide (the components as doubles)."""
    raw = F.col(vec_col).cast("array<double>")
    finite = F.forall(raw, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(raw) == length)).where(finite)
    narrow = F.forall(raw, lambda x: F.abs(x) < narrow_limit(length) / SCALE)
    vec = F.when(narrow, F.transform(raw, lambda x: F.floor(x * SCALE).cast("long")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.when(~narrow, raw).alias("wide"))


def whole(x: float) -> int:
    """floor(256 * x), exactly: a product by a power of two only overflows."""
    n, d = x.as_integer_ratio()
    return n * SCALE // d


class Centroids:
    """Integer centroids: 64-bit arrays where they are narrow, exact Python integers for all."""

    def __init__(self, exact: list[list[int]]):
        self.exact = exact
        self.narrow = np.array([all(abs(x) <= narrow_limit(len(c)) for x in c) for c in exact], bool)
        self.x = np.array([c if ok else [0] * len(c) for c, ok in zip(exact, self.narrow)], np.int64).reshape(len(exact), len(exact[0]) if exact else 0)
        self.float = np.array([[float(x) if abs(x) < 10**300 else np.copysign(np.inf, x) for x in c] for c in exact], np.float64).reshape(self.x.shape)

    def __len__(self) -> int:
        return len(self.exact)

    def half_gaps(self) -> np.ndarray:
        """Half the distance from each centroid to the next one, rather too small."""
        out = np.full(len(self), np.inf)
        for j in range(len(self)):
            far = [root(squared(self.exact[j], c)) for i, c in enumerate(self.exact) if i != j]
            out[j] = min(far, default=np.inf) / 2 * (1 - MARGIN)
        return out

    def ways(self, old: Centroids) -> np.ndarray:
        """How far each centroid has come, rather too long."""
        return np.array([root(squared(a, b)) for a, b in zip(self.exact, old.exact)]) * (1 + MARGIN)

    def digest(self, j: int) -> str:
        return hashlib.sha256(",".join(map(str, self.exact[j])).encode()).hexdigest()


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) * (x - y) for x, y in zip(a, b))


def root(n: int) -> float:
    """The square root of any integer as a float; infinite where no float holds it."""
    return float(np.sqrt(float(n))) if n < 10**300 else np.inf


def scan(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Of narrow vectors: cluster, distance to the second-nearest centroid (float, not squared), exact squared distance."""
    at = np.flatnonzero(centroids.narrow)
    far = np.full((len(x), len(centroids)), np.inf)  # floats, for screening the wide centroids
    for j in np.flatnonzero(~centroids.narrow):
        with np.errstate(over="ignore"):
            far[:, j] = ((x - centroids.float[j]) ** 2).sum(1)
    exact = np.full((len(x), len(centroids)), MOST)
    for j in at:
        d = x - centroids.x[j]
        exact[:, j] = np.einsum("ij,ij->i", d, d)
    if len(at) == len(centroids):
        cluster = exact.argmin(1)
        first = exact[np.arange(len(x)), cluster]
        exact[np.arange(len(x)), cluster] = MOST
        second = np.sqrt(exact.min(1).astype(np.float64)) if len(centroids) > 1 else np.full(len(x), np.inf)
        return cluster, second, first.tolist()
    # Some centroid is wide: it counts only where its float distance comes near the best narrow one.
    cluster, second, first = np.zeros(len(x), np.int64), np.zeros(len(x)), []
    for i, row in enumerate(x.tolist()):
        d = {int(j): int(exact[i, j]) for j in at}
        near = sorted(d.values())[1] if len(d) > 1 else None
        for j in np.flatnonzero(~centroids.narrow).tolist():
            if near is None or far[i, j] <= near * (1 + 1e-6) + 1:
                d[j] = squared(row, centroids.exact[j])
        order = sorted(d, key=lambda j: (d[j], j))
        cluster[i] = order[0]
        first.append(d[order[0]])
        second[i] = root(d[order[1]]) if len(order) > 1 else np.inf
    return cluster, second, first


def scan_wide(vec: list[int], centroids: Centroids) -> tuple[int, float, int]:
    d = [squared(vec, c) for c in centroids.exact]
    order = sorted(range(len(d)), key=lambda j: (d[j], j))
    return order[0], root(d[order[1]]) if len(order) > 1 else np.inf, d[order[0]]


class Step:
    """One round over a batch of vectors: bounds loosened, tested, and scans of the ambiguous ones."""

    def __init__(self, now: Centroids, ways: np.ndarray | None):
        self.now, self.gaps = now, now.half_gaps()
        if ways is not None:
            order = np.argsort(-ways)
            self.own = ways
            self.others = np.full(len(ways), ways[order[0]])  # the longest way of any other centroid
            self.others[order[0]] = ways[order[1]] if len(ways) > 1 else 0.0

    def narrow(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray, first: bool) -> tuple:
        if first:
            ambiguous = np.arange(len(x))
        else:
            with np.errstate(invalid="ignore"):  # of infinite bounds: not a number is never below a limit
                upper, lower = upper + self.own[cluster], np.maximum(0, lower - self.others[cluster])
            limit = np.maximum(lower * (1 - MARGIN), self.gaps[cluster])
            loose = np.flatnonzero(~(upper < limit))
            loose = loose[self.now.narrow[cluster[loose]]]
            upper[loose] = np.sqrt(self.exact(x[loose], cluster[loose]).astype(np.float64)) * (1 + MARGIN)
            ambiguous = np.flatnonzero(~(upper < limit))
        cluster, scans = cluster.copy(), scans.copy()
        if len(ambiguous):
            found, second, best = scan(x[ambiguous], self.now)
            cluster[ambiguous], lower[ambiguous] = found, second * (1 - MARGIN)
            upper[ambiguous] = np.array([root(b) for b in best]) * (1 + MARGIN)
            scans[ambiguous] += 1
        return cluster, upper, lower, scans

    def exact(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distances to own (narrow) centroids."""
        d = x - self.now.x[cluster]
        return np.einsum("ij,ij->i", d, d)

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> list[int | None]:
        out = self.exact(x, cluster).tolist()
        for i in np.flatnonzero(~self.now.narrow[cluster]).tolist():
            d = squared(x[i].tolist(), self.now.exact[cluster[i]])
            out[i] = d if d <= MOST else None
        return out


def _matrix(column: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are not null, and their components."""
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.drop_null().flatten().to_numpy()
    return at, flat.reshape(len(at), length)


def _round(table: DataFrame, now: Centroids, ways: np.ndarray | None, length: int, distance: bool = False) -> DataFrame:
    """The state after one assignment; distance adds the exact squared distance to the own centroid and leaves the vectors out."""
    sent = table.sparkSession.sparkContext.broadcast((now, ways))
    first = ways is None

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Step(*sent.value)
        for batch in batches:
            ids, vec, wide, *state = batch.columns
            n = batch.num_rows
            cluster, upper, lower, scans = (c.to_numpy(zero_copy_only=False).copy() for c in state) if not first else (np.zeros(n, np.int32), np.zeros(n), np.zeros(n), np.zeros(n, np.int32))
            far: list[int | None] = [None] * n
            at, x = _matrix(vec, length)
            if len(at):
                cluster[at], upper[at], lower[at], scans[at] = step.narrow(x, cluster[at], upper[at], lower[at], scans[at], first)
                if distance:
                    for i, d in zip(at.tolist(), step.distances(x, cluster[at])):
                        far[i] = d
            for i in np.flatnonzero(vec.is_null().to_numpy(zero_copy_only=False)).tolist():
                cluster[i], second, d = scan_wide([whole(c) for c in wide[i].as_py()], step.now)
                upper[i], lower[i], scans[i] = root(d) * (1 + MARGIN), second * (1 - MARGIN), scans[i] + 1
                far[i] = d if d <= MOST else None
            kept = [pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scans, pa.int32())]
            if distance:
                yield pa.RecordBatch.from_arrays([ids, kept[0], pa.array(far, pa.int64()), kept[3]], ["vec_id", "cluster", "distance", "scans"])
            else:
                yield pa.RecordBatch.from_arrays([ids, vec, wide, *kept], ["vec_id", "vec", "wide", "cluster", "upper", "lower", "scans"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long, scans int" if distance else STATE)


def digits(x: int) -> list[tuple[int, int]]:
    """The digits of base 2**DIGIT that are not zero, with their places; all of the number's sign."""
    out, place, left = [], 0, abs(x)
    while left:
        d = left & ((1 << DIGIT) - 1)
        if d:
            out.append((place, d if x > 0 else -d))
        left >>= DIGIT
        place += 1
    return out


def _wide_digits(table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, i, place, d) for c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, x in enumerate(v) for place, d in digits(whole(x))]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["cluster", "i", "place", "digit"])

    return table.where("wide is not null").select("cluster", "wide").mapInArrow(run, "cluster int, i int, place int, digit long")


def means(table: DataFrame, old: Centroids, length: int) -> Centroids:
    """floor(sum / count) of each cluster, exactly; an empty one keeps its centroid. A row per cluster reaches the driver."""
    sums = [F.sum(F.get("vec", F.lit(i))).alias(f"s{i}") for i in range(length)]
    rows = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("wide").isNotNull().cast("long")).alias("n_wide"), *sums).collect()
    total = {r.cluster: [r[f"s{i}"] or 0 for i in range(length)] for r in rows}
    if any(r.n_wide for r in rows):
        for r in _wide_digits(table).groupBy("cluster", "i", "place").agg(F.sum("digit").alias("d")).collect():  # clusters x components x places at most
            total[r.cluster][r.i] += r.d << (DIGIT * r.place)
    exact = list(old.exact)
    for r in rows:
        exact[r.cluster] = [t // r.n for t in total[r.cluster]]
    return Centroids(exact)


def first_centroids(rows: DataFrame, clusters: int, seed: str) -> Centroids:
    """The vectors with the smallest sha256 of `seed:vec_id`."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(mark, "vec", "wide").limit(clusters).collect()
    return Centroids([list(r.vec) if r.vec is not None else [whole(x) for x in r.wide] for r in chosen])


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, seed: str = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scans (how many full scans the vector has had)."""
    table = stored(usable(vectors, length, id_col, vec_col), "vectors")
    now, ways = first_centroids(table, clusters, seed), None
    spark = vectors.sparkSession
    if not len(now):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int")
    for _ in range(rounds):
        then = stored(_round(table, now, ways, length), "bounds")
        drop_stored(table)
        table, old = then, now
        now = means(table, old, length)
        ways = now.ways(old)
    found = stored(_round(table, now, ways, length, distance=True), "clusters")
    drop_stored(table)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()
    of = {r.cluster: None if r.lost or r.d > MOST else int(r.d) for r in sums}
    total = None if None in of.values() or sum(of.values()) > MOST else sum(of.values())
    known = T.StructType.fromDDL("cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    facts = spark.createDataFrame([(j, d, total, now.digest(j)) for j, d in of.items()], known)
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, seed: str = SEED) -> str:
    """The same rounds without bounds, each a CTE."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS vec FROM embeddings
        WHERE vec_id IS NOT NULL AND len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), vec) - 1)::INT AS cluster, vec AS cen FROM v QUALIFY cluster < {clusters})",
    ]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, vec_id, vec, arg_min(cluster, [d::HUGEINT, cluster]) AS cluster, min(d) AS distance FROM (
            SELECT r, vec_id, vec, cluster, list_sum(list_transform(list_zip(vec, cen), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k}) GROUP BY r, vec_id, vec)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS cen FROM (
                SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster)""")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.cen, c.cen) AS cen FROM c{k} c LEFT JOIN m{k} m USING (cluster))")
    return f"""WITH {', '.join(parts)}
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(cen, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE = _oracle()
