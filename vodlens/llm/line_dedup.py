"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A run is a table of (key, documents), dealt to buckets by key and sorted in them, so that a batch meets
the runs in sorted merges that move none of their rows. Each new batch of lines merge-anti-joins the runs
and adds its own: what it leaves out are the keys that some run has closed already, which need no
further count. When a
level holds FANOUT runs they are merged into one run of the next level, so n batches leave O(log n)
runs and every count is rewritten O(log n) times. Only hashes and counts are kept, never lines.

Two uses of the runs:
* LineRuns.add() takes a batch of documents, anti-joins its lines with all keys of the runs and tells
  the new ones (first come, first kept), then adds the batch's own run;
* drop_frequent_lines() reads its documents once, counts their keys by batch, feeds the batches to the
  runs (a key is closed at min_docs documents) and drops, everywhere, each line whose key is in at
  least min_docs documents of all batches together.

A key is a line without the ASCII white space at both ends and with A-Z lower-cased; in the runs it
is a 128-bit value (two xxhash64 over differently marked keys), so that equal values mean equal
lines. A row is a document: a repeated row, or one without id, counts as another document.

Defined results: a null or empty text is one empty line, which is never dropped while min_chars is
1; an empty table gives no rows; clashing extra columns are kept (drop) or ignored (digest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vodlens.llm.common import ASCII_SPACE, ascii_lower, dealt, drop_stored, plain, stored, stored_sorted

FANOUT = 4
#: More than FANOUT, so that levels fill and are merged.
BATCHES = 9


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows that are equal here, and never null."""
    return F.struct(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("d1"), F.xxhash64(F.col(text_col), F.lit(7), F.col(id_col).cast("string")).alias("d2"))


def keys_of(text: Column, min_chars: int) -> Column:
    """The hashed keys of a text's lines, each once, without those under min_chars code points."""
    keys = F.transform(lines_of(text), line_key)
    return F.array_distinct(F.transform(F.filter(keys, lambda k: F.char_length(k) >= min_chars), key_hash))


def key_counts(docs: DataFrame, text_col: str, min_chars: int, *by: Column) -> DataFrame:
    """h1, h2 and n (documents), for each value of `by` apart."""
    keys = docs.select(*by, F.explode(keys_of(F.col(text_col), min_chars)).alias("key"))
    names = [c for c in keys.columns if c != "key"]
    return keys.groupBy(*names, F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"))


class LineRuns:
    """The levels of runs; each run is a sorted table of h1, h2 and n (documents).

    closed: from how many documents on a key of a run is counted no further.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, closed: int | None = None):
        self.spark, self.fanout, self.closed = spark, fanout, closed
        self.levels: list[list[DataFrame]] = []

    def _runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self) -> DataFrame:
        """All runs as one table of counts."""
        return self._merge(self._runs())

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long")
        if len(runs) == 1:
            return runs[0]
        union = plain(runs[0])
        for run in runs[1:]:
            union = union.unionByName(plain(run))
        return dealt(union, "h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _without(self, counts: DataFrame, least: int) -> DataFrame:
        """The batch's rows whose keys no run holds with `least` documents: a merge anti-join with each run."""
        for run in self._runs():
            counts = counts.join(run.where(F.col("n") >= least).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return counts

    def append(self, counts: DataFrame) -> None:
        """Adds a batch's keys, but for closed ones, as a run of level 0 and compacts each level that is full."""
        rest = dealt(counts, "h1", "h2")
        rest = rest if self.closed is None else self._without(rest, self.closed)
        run, level = stored_sorted(rest, "line-run", "h1", "h2"), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            run = stored_sorted(self._merge(full), "line-run", "h1", "h2")
            for old in full:
                drop_stored(old)
            level += 1

    def add(self, docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
        """Adds a batch and returns its keys (h1, h2, n) that no earlier batch had."""
        counts = stored_sorted(dealt(key_counts(docs, text_col, min_chars), "h1", "h2"), "line-batch", "h1", "h2")
        fresh = stored(self._without(counts, 0), "line-fresh")
        self.append(counts)
        drop_stored(counts)
        return fresh

    def frequent(self, min_docs: int) -> DataFrame:
        return self.merged().where(F.col("n") >= min_docs).select("h1", "h2")

    def drop(self) -> None:
        for level in self.levels:
            for run in level:
                drop_stored(run)
        self.levels = []


def with_lines_split(docs: DataFrame, min_docs: int, min_chars: int = 1, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with l_n (lines), l_dropped (lines that go) and l_kept (the text that stays)."""
    spark = docs.sparkSession
    d1 = row_key(id_col, text_col)
    batch = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(batches)).cast("int").alias("batch")
    counts = stored(key_counts(docs, text_col, min_chars, batch), "line-counts", "batch")
    runs = LineRuns(spark, closed=min_docs)
    for k in range(batches):
        runs.append(counts.where(F.col("batch") == k).select("h1", "h2", "n"))
    frequent = stored(runs.frequent(min_docs), "line-frequent")
    runs.drop()
    drop_stored(counts)
    held = docs.select(d1.alias("d"), F.explode(keys_of(F.col(text_col), min_chars)).alias("key")).select("d", "key.h1", "key.h2")
    # Rows that are equal have equal keys, so one list for each row key serves them all.
    hits = held.join(frequent, ["h1", "h2"]).groupBy("d.d1", "d.d2").agg(F.collect_set(F.struct("h1", "h2")).alias("l_hits"))
    marked = docs.withColumn("l_d", d1)
    hits = hits.withColumnsRenamed({"d1": "l_d1", "d2": "l_d2"})
    joined = marked.join(hits, (F.col("l_d.d1") == F.col("l_d1")) & (F.col("l_d.d2") == F.col("l_d2")), "left")
    lines = lines_of(F.col(text_col))
    kept = F.when(F.col("l_hits").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.char_length(line_key(x)) < min_chars) | ~F.array_contains("l_hits", key_hash(line_key(x))))
    )
    split = joined.withColumn("l_lines", kept).withColumn("l_n", F.size(lines).cast("long"))
    split = split.withColumn("l_dropped", F.col("l_n") - F.size("l_lines")).withColumn("l_kept", F.array_join("l_lines", "\n"))
    return split.drop("l_d", "l_d1", "l_d2", "l_hits", "l_lines")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with the kept lines as their text; no row goes, and other columns stay."""
    out = with_lines_split(docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns}), min_docs, min_chars, batches, f"c_{id_col}", f"c_{text_col}")
    text = F.when((F.col("l_dropped") == 0) & F.col(f"c_{text_col}").isNull(), F.lit(None)).otherwise(F.col("l_kept"))
    return out.select(*[(text if c == text_col else F.col(f"c_{c}")).alias(c) for c in docs.columns])


def line_digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text."""
    split = with_lines_split(docs.select("doc_id", "text"), min_docs, min_chars, batches)
    return split.select("doc_id", F.col("l_n").alias("n_lines"), F.col("l_dropped").alias("n_dropped"), F.sha2("l_kept", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '') AS text
  FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept
"""
