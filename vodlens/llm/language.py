"""Language ID: error-correcting output codes over binary n-gram classifiers.

Each learned language has a codeword; each bit of the code splits the languages in two, and a binary
classifier of letter n-grams predicts that bit. Up to seven languages the code holds every split (an
exhaustive code), beyond that random splits with the rows as far apart as a fixed search finds.

Letters are lower-cased, all else becomes one space; n-grams of one to three characters fall into SLOTS
slots. Their counts come from all training texts, summed by language and slot. A classifier's weight of
a slot is the log of its mean share among the languages of one side over that among the other side, so a
frequent language has no more say than a rare one. The margin of a text is its mean weight, scaled by
the root of its length; a logistic regression per bit turns margins into log odds, fitted on whole texts
and short pieces of a bounded sample of training texts (about SAMPLE for each language, by a hash).

Decoding is weighted by loss: the codeword with the smallest sum of logistic losses over all bits, each
weighted by how far its classifier beats chance on the sample, is the nearest. Two codewords differ in
many bits that tell of the same letters, so losses are divided by the mean number of bits in which two
codewords differ; the score is the nearest's share among the exponentials of the negative losses. Where
the second codeword's loss is within MARGIN of the nearest's, the text is flagged as ambiguous.

Inputs of a prediction: the text alone. Defined results: a null text, one without a letter, or any text
where nothing was learned is `und` with score 0; with one learned language every other text is that one
with score 1; a tie goes to the language that comes first by name; repeated rows train and get a row
each; an empty table gives no rows; other columns are ignored. Texts are read in parts, whatever their size.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vodlens.llm.common import crc_mod, drop_stored, freed, stored
from vodlens.llm.quality import logistic

SLOTS = 1 << 16
SMOOTH = 0.5
SAMPLE, PIECES = 1_000, (20, 60, 200)
MARGIN = 2.0
HELD_OUT_MOD, HELD_OUT = 3, 1
#: Characters of a text that are read at once.
PART = 1_000_000
NO_LANGUAGE = "und"
#: Odd constants of the n-gram hash.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_TABLE: list[np.ndarray] = []


def lowered() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _TABLE:
        low = lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c)
        _TABLE.append(np.array([low(chr(k)) if chr(k).isalpha() else 0 for k in range(0x110000)], np.uint32))
    return _TABLE[0]


def slots_of(text: str) -> Iterator[np.ndarray]:
    """The slots of a text's n-grams, in parts; the last two characters of a part go before the next one."""
    before = np.zeros(1, np.uint32)
    for at in range(0, len(text), PART):
        codes = lowered()[np.frombuffer(text[at : at + PART].encode("utf-32-le", "surrogatepass"), "<u4")]
        codes = np.concatenate([before, codes, np.zeros(int(at + PART >= len(text)), np.uint32)])
        codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])].astype(np.uint64)
        new = len(before)  # the place of the part's first own character
        one = codes * MIX[0]
        two = one[:-1] + codes[1:] * MIX[1]
        three = two[:-1] + codes[2:] * MIX[2]
        mixed = np.concatenate([one[new:][codes[new:] != 0] + np.uint64(1), two[new - 1 :] * np.uint64(3), three[max(0, new - 2) :] * np.uint64(7)]) * MIX[1]
        before = codes[-2:].astype(np.uint32)
        yield ((mixed ^ (mixed >> np.uint64(29))) * MIX[0] >> np.uint64(48)).astype(np.int64) % SLOTS


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def codewords(n: int) -> np.ndarray:
    """n rows of bits (+1 or -1), no column constant: all splits up to seven languages, else random ones far apart."""
    if n < 2:
        return np.zeros((n, 0), np.int64)
    if n <= 7:
        others = range(1, n)
        splits = [set(s) | {0} for size in range(n - 1) for s in combinations(others, size)]
        return np.array([[1 if k in s else -1 for s in splits] for k in range(n)], np.int64)
    bits, best, apart = math.ceil(10 * math.log2(n)), None, -1
    for seed in range(20):
        code = np.random.default_rng(seed).integers(0, 2, (n, bits)) * 2 - 1
        code[0, np.abs(code.sum(0)) == n] *= -1
        least = int((bits - (code @ code.T + bits * np.eye(n, dtype=np.int64) * -2).max()) // 2)
        if least > apart:
            best, apart = code, least
    return best


class Codes:
    """Languages, their codewords, the weights of the binary classifiers, and their calibration."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray):
        self.languages, self.code, self.weights = languages, code, weights
        self.odds = np.tile([0.0, 1.0, 0.0], (code.shape[1], 1))
        self.trust = np.ones(code.shape[1])
        n = len(languages)
        self.apart = (n * n * code.shape[1] - (code @ code.T).sum()) / (2 * n * (n - 1)) if n > 1 else 1.0

    def margins(self, text: str) -> tuple[int, np.ndarray]:
        """How many n-grams, and each classifier's mean weight."""
        n, total = 0, np.zeros(self.code.shape[1])
        for slots in slots_of(text):
            n += len(slots)
            total += self.weights[slots].sum(0, dtype=np.float64)
        return n, total / max(1, n)

    @staticmethod
    def terms(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Inputs of a bit's calibration: the margin, and the margin by the root of the length."""
        return np.stack([np.ones(len(n)), mean, mean * np.sqrt(np.minimum(n, 2_000))], axis=1)

    def losses(self, n: int, mean: np.ndarray) -> np.ndarray:
        """The weighted loss of each codeword, in units of the mean distance between codewords."""
        odds = np.array([float(self.terms(np.array([n]), mean[b : b + 1])[0] @ self.odds[b]) for b in range(len(mean))])
        return (np.logaddexp(0, -self.code * np.clip(odds, -30, 30)) * self.trust).sum(1) / self.apart

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the choice is ambiguous."""
        if not text or not self.languages or not has_letter(text):
            return NO_LANGUAGE, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = self.losses(*self.margins(text))
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        return self.languages[int(order[0])], float(1 / share.sum()), bool(loss[order[1]] - loss[order[0]] < MARGIN)

    def calibrate(self, language: np.ndarray, n: np.ndarray, mean: np.ndarray) -> None:
        """Fits each bit's log odds and its trust; every language weighs the same."""
        if not len(language):
            return
        sizes = np.bincount(language, minlength=len(self.languages))
        weight = len(language) / (sizes[language] * np.count_nonzero(sizes))
        for b in range(self.code.shape[1]):
            y = (self.code[language, b] > 0).astype(float)
            if 0 < y.sum() < len(y):
                x = self.terms(n, mean[:, b])
                self.odds[b] = logistic(x, y, weight)
                right = ((x @ self.odds[b] > 0) == (y > 0)) * weight
                self.trust[b] = max(0.01, 2 * right.sum() / weight.sum() - 1)


def counts(texts: DataFrame) -> DataFrame:
    """lang, slot and count over all texts (lang, text): added up in each task first."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "slot", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in held and len(held) >= 64:  # 32 MB of counts
                    yield from given()
                total = held.setdefault(lang, np.zeros(SLOTS, np.int64))
                for slots in slots_of(text.as_py()):
                    total += np.bincount(slots, minlength=SLOTS)
        yield from given()

    return texts.select("lang", "text").mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def constant(value: list | dict, kind: str) -> Column:
    """A Python value as one literal, however many numbers it holds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def classifier_weights(counted: DataFrame, languages: list[str], totals: dict[str, int], code: np.ndarray) -> np.ndarray:
    """SLOTS x bits log shares, worked out by slot in Spark; slots that no text has get the weights of zero counts."""
    none = [SMOOTH / (totals[g] + SMOOTH * SLOTS) for g in languages]
    rate = constant([1 / (totals[g] + SMOOTH * SLOTS) for g in languages], "array<double>")
    place = constant({g: k for k, g in enumerate(languages)}, "map<string,int>")
    by_slot = counted.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct(F.try_element_at(place, F.col("lang")).alias("k"), "n"))).alias("m"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), lambda k: (F.coalesce(F.try_element_at("m", k), F.lit(0)) + SMOOTH) * F.get(rate, k))
    by_slot = by_slot.select("slot", shares.alias("p"))
    sides = [(np.flatnonzero(code[:, b] > 0).tolist(), np.flatnonzero(code[:, b] < 0).tolist()) for b in range(code.shape[1])]
    masks = constant([[1 / len(up) if k in up else -1 / len(down) for k in range(len(languages))] for up, down in sides], "array<array<double>>")
    total = lambda mask, sign: F.aggregate(F.zip_with("p", mask, lambda p, w: F.greatest(F.lit(0.0), p * w * sign)), F.lit(0.0), lambda a, x: a + x)
    rows = by_slot.select("slot", F.transform(masks, lambda m: (F.log(total(m, 1)) - F.log(total(m, -1))).cast("float")).alias("w")).collect()  # SLOTS rows at most
    side = lambda ks: sum(none[k] for k in ks) / len(ks)
    out = np.tile(np.array([math.log(side(up) / side(down)) for up, down in sides], np.float32), (SLOTS, 1))
    for r in rows:
        out[r.slot] = r.w
    return out


def pieces(text: str) -> list[str]:
    """The whole text and a piece of each length in PIECES, from its middle."""
    middle = len(text) // 2
    return [text, *[text[middle : middle + size] for size in PIECES if size < len(text) - middle]]


def measured(texts: DataFrame, model: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, n-grams and margins of a sample of texts and their pieces."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            rows = [(m.languages.index(lang), *m.margins(p)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in pieces(text) if has_letter(p)]
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["language", "n", "mean"])

    rows = texts.select("lang", "text").mapInArrow(run, "language int, n long, mean array<double>").collect()
    rows.sort(key=lambda r: (r.language, r.n, r.mean))
    return np.array([r.language for r in rows], np.int64), np.array([r.n for r in rows], float), np.array([r.mean for r in rows]).reshape(len(rows), -1)


def fit(docs: DataFrame, held_out_mod: int = HELD_OUT_MOD, held_out: int = HELD_OUT, sample: int = SAMPLE) -> Codes:
    """Learns from the text and lang of all rows outside the held-out remainder."""
    training = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), held_out_mod) != held_out))
    counted = stored(counts(training), "language-counts")
    sums = counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()
    totals = {r.lang: r.n for r in sums}
    languages = sorted(totals)
    code = codewords(len(languages))
    if len(languages) < 2:
        drop_stored(counted)
        return Codes(languages, code, np.zeros((SLOTS, 0), np.float32))
    model = Codes(languages, code, classifier_weights(counted, languages, totals, code))
    drop_stored(counted)
    texts = {r.lang: r.n for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = constant({g: int(min(1.0, sample / texts[g]) * 1_000_000) for g in languages}, "map<string,int>")
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang"))
    model.calibrate(*measured(training.where(chosen), model))
    return model


def identify(docs: DataFrame, model: Codes, held_out_mod: int = HELD_OUT_MOD, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(x.as_py()) for x in batch.column(2)]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    held = crc_mod(F.col("doc_id"), held_out_mod) == held_out
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
