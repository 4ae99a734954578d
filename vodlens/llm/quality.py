"""Quality classifier: zstandard dictionaries of good and of bad text.

A text is cut into blocks of BLOCK bytes and each block is compressed once with a dictionary trained
on good text and once with one trained on bad text. Small blocks keep the dictionaries in charge: a
long text does not become its own dictionary. The normalised size difference over all blocks
(bad - good) / (bad + good) tells which dictionary fits better, and the compression ratio tells text
that repeats itself. A logistic regression, fitted on labelled texts that no dictionary has seen,
turns both into the probability of label 1.

Bounded sample: the dictionaries and the regression see at most SAMPLE labelled rows per label, chosen
by a hash of the row, of any length: of a text over SAMPLE_CHARS characters they see PIECES evenly spaced
pieces of PIECE characters, of the others all. Of each text BLOCKS_PER_TEXT evenly spaced blocks and more
(up to twice as many) train a dictionary. Scoring reads every whole text. Labels, lang, source and
doc_id are never inputs of a score.

Defined results: a null text counts as empty; an empty text gets the score of a text whose sizes
are equal; without any usable label the score is 0.5, with one label only it is that label's;
repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vodlens.llm.common import crc_mod, freed

SAMPLE, SAMPLE_CHARS = 3_000, 20_000
PIECES, PIECE = 20, 1_000
BLOCK, DICTIONARY, LEVEL = 1024, 112_640, 3
BLOCKS_PER_TEXT = 8
THRESHOLD = 0.7


def blocks_of(raw: bytes) -> list[bytes]:
    return [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]


def train_dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary from evenly spaced blocks of each text; plain content where there is too little to train."""
    samples = []
    for raw in texts:
        blocks = blocks_of(raw)
        samples += blocks[:: max(1, len(blocks) // BLOCKS_PER_TEXT)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class SizeModel:
    """Both dictionaries and the calibration; small, so that it travels with the task."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None, constant: float | None = None):
        self.good, self.bad, self.weights, self.constant = good, bad, weights, constant

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pair"}

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        if "pair" not in self.__dict__:
            self.pair = tuple(zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d)) for d in (self.good, self.bad))
        return self.pair

    def features(self, text: str) -> list[float]:
        good, bad = self.compressors()
        raw = text.encode("utf-8", "replace")
        if not raw:
            return [0.0, 0.0]
        g = b = 0
        for block in blocks_of(raw):
            g += len(good.compress(block))
            b += len(bad.compress(block))
        return [(b - g) / (b + g), float(np.log((b + g) / (2 * len(raw))))]

    @staticmethod
    def terms(x: np.ndarray) -> np.ndarray:
        d, r = 10 * x[:, 0], x[:, 1]
        return np.stack([np.ones(len(x)), d, r, d * d, d * r, r * r], axis=1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.empty(0)
        z = self.terms(np.array([self.features(t) for t in texts])) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Newton's method with step halving and a ridge."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (w @ w) / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - then < 1e-9 * abs(now):
            break
        w, now = w + step, then
    return w


def own_lines(good: list[str], bad: list[str]) -> tuple[list[str], list[str]]:
    """Both samples without the lines that stand in texts of both labels: these speak for neither."""
    sets = [{line for t in part for line in t.split("\n")} for part in (good, bad)]
    shared = sets[0] & sets[1]
    out = [["\n".join(line for line in t.split("\n") if line not in shared) for t in part] for part in (good, bad)]
    return tuple([t for t in part if t] or old for part, old in zip(out, (good, bad)))


def fit_texts(good: list[str], bad: list[str], share_good: float | None = None) -> SizeModel:
    """Every second text trains the dictionaries, the others calibrate, weighted to the labels' shares."""
    if not good or not bad:
        return SizeModel(b"", b"", constant=0.5 if not good and not bad else float(bool(good)))
    raw = [[t.encode("utf-8", "replace") for t in part] for part in own_lines(good[::2], bad[::2])]
    model = SizeModel(*map(train_dictionary, raw))
    held = [part[1::2] or part for part in (good, bad)]
    y = np.repeat([1.0, 0.0], [len(part) for part in held])
    share = len(good) / (len(good) + len(bad)) if share_good is None else share_good
    weight = np.where(y == 1, share / len(held[0]), (1 - share) / len(held[1])) * len(y)
    model.weights = logistic(model.terms(np.array([model.features(t) for part in held for t in part])), y, weight)
    return model


def spaced(text: Column) -> Column:
    """A text of at most SAMPLE_CHARS characters as it is, of a longer one its evenly spaced pieces."""
    last = F.char_length(text) - PIECE
    at = lambda k: (k * last / (PIECES - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(text, at(k), F.lit(PIECE)))
    return F.when(F.char_length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(pieces, "\n"))


def fit(docs: DataFrame, labels: DataFrame, held_out_mod: int = 4, held_out: int = 2, sample: int = SAMPLE) -> SizeModel:
    """Fits on labelled rows outside the held-out remainder, at most `sample` for each label."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(crc_mod(F.col("doc_id"), held_out_mod) != held_out)
    usable = usable.select("doc_id", "quality").distinct()
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    # Only ids are ordered and collected; then the texts of these few documents, by a broadcast of their ids.
    chosen = [(r.doc_id, q) for q in (1, 0) for r in usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.char_length("text") > 0).join(F.broadcast(ids), "doc_id")
    texts = texts.withColumn("text", spaced(F.col("text")))
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    by_label = [[r.text for r in rows if r.quality == q] for q in (1, 0)]
    return fit_texts(*by_label, share_good=counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: SizeModel, threshold: float = THRESHOLD, held_out_mod: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores([x.as_py() or "" for x in batch.column(2)])
            cols = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    held = crc_mod(F.col("doc_id"), held_out_mod) == held_out
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: SizeModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores([x.as_py() or "" for x in batch.column(at)])
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
