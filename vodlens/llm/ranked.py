"""Ranked lexical search: Fagin's threshold algorithm over impact-sorted lists.

The forward index holds a row for each document: its length and, of the words that some item asks for,
the counts. Whole texts are read once, in the tasks that read the table; lengths, document frequencies
and the constants of the score come from the stored index, over all documents. It is cut into groups of
documents where it lies, without a shuffle. In a group the impacts of all (word, document) entries are
computed once and sorted into a list per word. An item goes down the lists of its words round-robin, a
few entries of each list at a time; every document that turns up for the first time is looked up in the
forward index, which gives its whole score. The threshold is the score of a document that would stand
at the present depth of all lists: no unseen document can have more. The item stops when the threshold
falls strictly below its k-th score (strictly, because equal scores go by doc_id). The k best of one
group are the start of the next, and of each task at most k rows per item leave.

First thresholds: the k-th score of each item in a sample of at most SAMPLE documents. Any k scores are
a lower bound of the true k-th one, so the sample changes no result, only how deep the lists are read.

Items are taken in blocks of about BLOCK items, each block a pass over the documents; what a block sends
to the tasks is checked (SENT_BYTES), and a larger block is split. A group ends at GROUP documents or
ENTRIES entries.

Defined results: a null text (of a document or an item) has no terms; a document without terms has no
part in N or L and no score; an item without terms that any document holds gets no rows; rows repeated
in the documents count and rank each for themselves; items are told apart by item_id and text, and
repeated ones get one result; a null doc_id ranks behind all others on equal scores; an empty table
gives no rows; other columns are ignored. A single term may be of any length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vodlens.llm.common import drop_stored, freed, stored

K = 20
BLOCK, SENT_BYTES, SAMPLE = 4_096, 64_000_000, 16_384
GROUP, ENTRIES, FIRST = 16_384, 2_000_000, 16
#: Bytes of a text that are split into words at once.
PART = 1_000_000
#: Fixed values of the score: saturation (k1 = 1.2, in thousandths and in percent of m) and the weight of length (b = 0.25).
SCALE, UNIT, SATURATION, LENGTH, WHOLE = 1_000_000_000, 1_000, 12, 25, 100
#: ASCII letters and digits, and every byte of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
FORWARD = "doc_id long, n long, words array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"
LAST = (1 << 63) - 1


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in parts: only A-Z are lower-cased."""
    raw = raw.lower()  # of bytes: ASCII only
    at = 0
    while at < len(raw):
        cut = BREAK.search(raw, at + PART) if len(raw) - at > PART else None
        end = cut.end() if cut else len(raw)
        yield WORD.findall(raw, at, end)
        at = end


def counted(text: str | None) -> Counter:
    out: Counter = Counter()
    for part in words_of((text or "").encode("utf-8", "replace")):
        out.update(part)
    return out


def forward_index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n, words (numbers) and counts of each document that has a term; documents without one have no row."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, sizes, words, counts = [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, mine = 0, {}
                for part in words_of(raw.as_py()):
                    n += len(part)
                    for w, c in Counter(filter(known.__contains__, part)).items():
                        mine[known[w]] = mine.get(known[w], 0) + c
                if n:
                    ids.append(doc_id)
                    sizes.append(n)
                    words.append(list(mine))
                    counts.append(list(mine.values()))
            cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "words", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).where("text is not null").mapInArrow(run, FORWARD)


class Scores:
    """The constants of the score over all documents, and each word's weight."""

    def __init__(self, docs: int, terms: int, df: np.ndarray):
        self.docs, self.terms = docs, terms
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) if d else 0 for d in df], np.int64)

    def impacts(self, word: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = WHOLE - LENGTH + (LENGTH * n * self.docs) // self.terms
        return self.weight[word] * ((SCALE * tf) // (UNIT * tf + SATURATION * m))


class Best:
    """The k best documents of one item so far; floor: a score that the k-th of all reaches."""

    def __init__(self, k: int, floor: int = 0):
        self.k, self.floor = k, floor
        self.score, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        enough = score >= max(1, self.least())
        score, ids = np.concatenate([self.score, score[enough]]), np.concatenate([self.ids, ids[enough]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]

    def least(self) -> int:
        return max(self.floor, int(self.score[-1])) if len(self.score) == self.k else self.floor


class Group:
    """Some documents: the forward index, and a list per word of its entries by falling impact."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray, scores: Scores):
        self.ids = ids
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.words = words
        self.impact = scores.impacts(words, counts.astype(np.int64), np.repeat(n, sizes))
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.lexsort((-self.impact, words))
        self.listed_doc, self.listed_impact = doc[order], self.impact[order]
        self.list_start = np.searchsorted(words[order], np.arange(len(scores.weight) + 1))

    def looked_up(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """The whole scores of some documents; times: how often an item asks for each word."""
        size = self.start[docs + 1] - self.start[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[docs] - ends + size, size)
        return np.add.reduceat(times[self.words[at]] * self.impact[at], ends - size)

    def search(self, words: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Runs one item; returns how many entries of its lists were read."""
        low, high = self.list_start[words], self.list_start[words + 1]
        some = high > low
        words, low, high = words[some], low[some], high[some]
        if not len(words):
            return 0
        many, seen = times[words], np.zeros(len(self.ids), bool)
        at, step, first = low.copy(), FIRST, low
        while True:
            open_ = at < high
            threshold = int((many[open_] * self.listed_impact[at[open_]]).sum())
            if threshold == 0 or threshold < best.least():
                return int((at - first).sum())
            then = np.minimum(at + step, high)
            docs = np.unique(np.concatenate([self.listed_doc[a:b] for a, b in zip(at, then)]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            if len(docs):
                best.add(self.looked_up(docs, times), self.ids[docs])
            at = then
            step *= 2


class Item:
    """An item's words as numbers, and how often it asks for each."""

    def __init__(self, terms: Counter, numbers: dict[bytes, int]):
        found = sorted((numbers[w], c) for w, c in terms.items())
        self.words = np.array([w for w, _ in found], np.int64)
        self.times = np.array([c for _, c in found], np.int64)


def searched(forward: DataFrame, items: list[Item], scores: Scores, floors: list[int], k: int, group: int = GROUP) -> DataFrame:
    """item (place in the list), doc_id and score: at most k rows for each item and task."""
    sent = forward.sparkSession.sparkContext.broadcast((items, scores, floors))

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, constants, least = sent.value
        best = [Best(k, f) for f in least]
        times = np.zeros(len(constants.weight), np.int64)
        held: list[tuple] = []

        def answer() -> None:
            parts = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            rows = Group(*parts, constants)
            for item, mine in zip(asked, best):
                times[item.words] = item.times
                rows.search(item.words, times, mine)
                times[item.words] = 0

        for batch in batches:
            for b in range(0, batch.num_rows, group):
                part = batch.slice(b, group)
                ids, n, words, counts = part.columns
                ends = words.offsets.to_numpy()
                flat = slice(ends[0], ends[-1])
                held.append((ids.fill_null(LAST).to_numpy(), n.to_numpy(), np.diff(ends), words.values.to_numpy()[flat], counts.values.to_numpy()[counts.offsets.to_numpy()[0] : counts.offsets.to_numpy()[-1]]))
                if sum(len(h[0]) for h in held) >= group or sum(len(h[3]) for h in held) >= ENTRIES:
                    answer()
        if held:
            answer()
        for j, mine in enumerate(best):
            if len(mine.ids):
                cols = [pa.array([j] * len(mine.ids), pa.int32()), pa.array(mine.ids, mask=mine.ids == LAST), pa.array(mine.score)]
                yield pa.RecordBatch.from_arrays(cols, ["item", "doc_id", "score"])

    return forward.where(F.size("words") > 0).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, rows: list[tuple], k: int, sample: int, group: int) -> DataFrame:
    """The results of one block of items, as a stored table."""
    spark = docs.sparkSession
    terms = [counted(text) for _, text in rows]
    numbers = {w: j for j, w in enumerate(sorted(set().union(*terms)))}
    forward = stored(forward_index(docs, numbers), "forward-index")
    total = forward.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(numbers), np.int64)
    for r in forward.select(F.explode("words").alias("w")).groupBy("w").count().collect():  # a row for each word that the block asks for
        df[r.w] = r["count"]
    items, scores = [Item(t, numbers) for t in terms], Scores(total.docs, total.terms or 1, df)
    share = min(1.0, sample / max(1, total.docs))
    some = forward.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample)
    kth = searched(some, items, scores, [0] * len(items), k, group).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.sort_array(F.collect_list("score"), False).alias("s"))
    floors = [0] * len(items)
    for r in kth.where(F.col("c") >= k).select("item", F.get("s", F.lit(k - 1)).alias("kth")).collect():
        floors[r.item] = r.kth
    names = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(rows)], "item int, item_id long")
    top = _ranked(searched(forward, items, scores, floors, k, group), k).join(F.broadcast(names), "item")
    out = stored(top.select("item_id", "rank", "doc_id", "score"), "ranked")
    drop_stored(forward)
    return out


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK, sent_bytes: int = SENT_BYTES, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item, by descending score and then doc_id."""
    asked = items.select(F.col("item_id").cast("long"), "text").where(F.char_length("text") > 0).distinct()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // block), -(-(size.bytes or 0) // sent_bytes))
    out = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        mine = sorted(((r.item_id, r.text) for r in mine if counted(r.text)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if mine:
            found = _block(docs, mine, k, sample, group)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


ORACLE = r"""
WITH terms AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT d, doc_id, len(t)::BIGINT AS n, t FROM terms WHERE len(t) > 0),
stats AS (SELECT count(*)::BIGINT AS c, sum(n)::BIGINT AS l FROM docs),
tf AS (SELECT d, w, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS w FROM docs) GROUP BY d, w),
df AS (SELECT w, count(*)::BIGINT AS df FROM tf GROUP BY w),
weights AS (SELECT w, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, stats),
asked AS (
  SELECT item_id, w, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark)
  GROUP BY item_id, w),
scored AS (
  SELECT a.item_id, x.doc_id, x.d,
         sum(a.times * g.weight * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + (25 * x.n * s.c) // s.l))))::BIGINT AS score
  FROM asked a JOIN weights g USING (w) JOIN tf f USING (w) JOIN docs x ON x.d = f.d CROSS JOIN stats s
  GROUP BY a.item_id, x.doc_id, x.d)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
