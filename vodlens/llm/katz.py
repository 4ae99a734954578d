"""LM scoring: a Katz backoff model of words with Good-Turing discounts, of any order (bigrams by default).

Tokens are the words of a text (runs of other than ASCII white space, A-Z lower-cased) and one end
token, which also fills the context before a text's first token. A seen gram (h, w) of count r has
probability d(r) * r / c(h); an unseen one has alpha(h) * p(w | h'), where h' is h without its first
word, and so on down to p(w), which is d'(c) * c / N for a known word and the left-over mass for the
single unknown word. Contexts that training never saw back off with weight one. d are Katz's Good-Turing
discounts of each order for counts up to K; larger counts keep all but REST of their mass, so that every
context can back off. alpha(h) = (1 - seen mass) / (1 - sum of p(w | h') over seen w) normalises each
context exactly: a gram seen in training has its shorter grams seen too, so both sums are over discounted
counts, and are kept as integer counts of counts, which no order of addition can change.

Plan. Texts are read once, into stored blocks of about BLOCK_CHARS characters: a block's number is
written with it, so that whatever runs again meets the same blocks. A block sends each distinct gram
of each order once, with its training count, to the part of its hash (Spark moves packed rows of many
keys). A part adds the counts up, keeps them as its piece of the stored model tables and replies to
each block in the order of its keys. So hot grams are pre-aggregated, every part has about
PART_CHARS characters' worth of keys at any input size, and the driver sees nine sums an order. The stored blocks
then turn the replies into scores and send the backoff sums, of which a last exchange makes the weights
of those contexts that some block has to back off from.

Grams are known by 64-bit hashes in the tables (xxHash of the word; mixed with the context's for longer ones).

Defined results: a null text counts as empty, whose only token is its end; without training texts
every token is unknown and scores 0 (probability 1 for the one unknown word); a null doc_id counts as
training; repeated rows count and score each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.llm.common import crc_mod, drop_stored, stored

K, REST = 5, 1e-6
#: Words of a gram.
ORDER = 2
BLOCK_CHARS, PART_CHARS, LEAST_PARTS = 6_000_000, 4_000_000, 16
MOST_PARTITIONS = 10_000
END = b"\n"
WORDS, PAIRS = 0, 1
MIXED = "kind int, block long, part int, payload binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
OUT_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def pack(*values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, protocol=5))


def unpack(raw: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, which compresses to what tells them apart."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def discounts(n: np.ndarray, k: int = K) -> np.ndarray:
    """d(0..k) from n[r], the number of types seen r times; absolute discounting where they fail."""
    out = np.ones(k + 1)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - absolute) / r
    return out


class Discounted:
    """Discounted counts by count."""

    def __init__(self, n: np.ndarray):
        self.d = discounts(n)
        self.of = self.d * np.arange(len(self.d))  # d(r) * r for r up to K

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return np.where(r <= K, self.of[np.minimum(r, K)], r * (1 - REST))

    def total(self, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        """From numbers of types with counts 1..K, and the sum of the larger counts."""
        return small @ self.of[1:] + large * (1 - REST)


END_HASH = np.uint64(xxhash.xxh64_intdigest(END))
#: Stands for the context of several ends before a text; a text without words has such a gram of its own.
PAD_HASH = np.uint64(xxhash.xxh64_intdigest(END, 1))


def int_planes(x: np.ndarray) -> bytes:
    """Small numbers byte by byte, so that the empty high bytes vanish when packed."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_int_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def block_of(ids: list, held: list[bool], texts: list[str]) -> bytes:
    """Some documents, packed: their tokens, numbered by the block's own distinct words in the order of their hashes."""
    tokens: list[bytes] = []
    lens = np.empty(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "replace").lower().split()
        tokens += words
        tokens.append(END)
        lens[k] = len(words) + 1
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    del tokens
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return pack(ids, np.array(held, bool), lens, planes(hashes[order]), int_planes(place[coded.indices.to_numpy()]))


class Grams:
    """A block's distinct grams of one order, in the order of their keys; contexts are those of the order below."""

    def __init__(self, below: Grams | None, words: np.ndarray, cur: np.ndarray, starts: np.ndarray):
        self.below = below
        if below is None:
            self.keys, self.at = words, cur
            return
        if below.below is None:
            self.context_keys, pad = words, np.searchsorted(words, END_HASH)
        else:
            self.context_keys, pad = np.append(below.keys, PAD_HASH), len(below.keys)
        self.context_at = np.empty_like(below.at)
        self.context_at[1:] = below.at[:-1]
        self.context_at[starts] = pad
        distinct, first, gram = np.unique(self.context_at * max(1, len(words)) + cur, return_index=True, return_inverse=True)
        context, word = np.divmod(distinct, max(1, len(words)))
        keys = mixed(self.context_keys[context], words[word])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first = first[order]
        self.keys, self.context, self.at = keys[order], context[order], place[gram]
        self.lower = below.at[first]
        self.lower_context = None if below.below is None else below.context_at[first]

    def context_counts(self, counts: list[np.ndarray], level: int, end: int) -> np.ndarray:
        """How often training has each context, from the counts of the grams below."""
        return counts[0] if level == 2 else np.append(counts[level - 2], counts[0][end])


class Block:
    """A packed block again, with its grams of all orders."""

    def __init__(self, raw: bytes, order: int):
        self.ids, self.held, self.lens, words, cur = unpack(raw)
        self.words, self.cur = from_planes(words), from_int_planes(cur)
        starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64) if len(self.lens) else np.empty(0, np.int64)
        self.end = int(np.searchsorted(self.words, END_HASH))
        self.levels = [Grams(None, self.words, self.cur, starts)]
        for _ in range(order - 1):
            self.levels.append(Grams(self.levels[-1], self.words, self.cur, starts))

    def counts(self, kind: int) -> np.ndarray:
        """How often the training documents have each gram."""
        level = self.levels[kind]
        return np.bincount(level.at[~np.repeat(self.held, self.lens)], minlength=len(level.keys))


def part_slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Parts are equal ranges of the sorted keys' top bits, so a part's keys are neighbours."""
    part = (keys >> np.uint64(32)).astype(np.int64) * parts >> 32
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in np.unique(part).tolist():
        yield p, slice(int(edges[p]), int(edges[p + 1]))


def _blocks(block_chars: int) -> Callable:
    """Documents as packed blocks, each with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for a, b, c in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids.append(a.as_py())
                held.append(b.as_py())
                texts.append(c.as_py())
                size += len(texts[-1])
                if size >= block_chars:
                    yield rows_batch([(-1, number, 0, block_of(ids, held, texts))])
                    ids, held, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield rows_batch([(-1, number, 0, block_of(ids, held, texts))])

    return run


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "block", "part", "payload"])


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of a sorted partition, group by group."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(row)
    if held:
        yield now, held


class KatzModel:
    """The sums that every task needs; the tables stay in the shared folder."""

    def __init__(self, histograms: list[np.ndarray], tokens: int, types: int):
        self.tokens, self.types = tokens, types
        self.levels = [Discounted(n) for n in histograms]
        few, many = histograms[0][1 : K + 1], histograms[0][-1]
        self.seen = (float(self.words.total(few, many)) / tokens) if tokens else 0.0

    @property
    def order(self) -> int:
        return len(self.levels)

    @property
    def words(self) -> Discounted:
        return self.levels[0]

    @property
    def pairs(self) -> Discounted:
        return self.levels[1]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """p(w) by training count; 0 stands for the unknown word."""
        if not self.tokens:
            return np.ones(len(c))
        return np.where(c > 0, self.words(c) / self.tokens, 1 - self.seen)

    def alpha(self, level: int, c: np.ndarray, below: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Backoff weights of an order's contexts with counts c, and `below` for their shorter contexts; 1 for unknown ones."""
        left = 1 - self.levels[level - 1].total(sums[:K].T, sums[K]) / np.maximum(c, 1)
        rest = 1 - self.levels[level - 2].total(sums[K + 1 : 2 * K + 1].T, sums[2 * K + 1]) / np.maximum(below, 1)
        return np.where(c > 0, left / rest, 1.0)


def _requests(parts: int, order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("block").to_pylist(), batch.column("payload")):
                block = Block(raw.as_py(), order)
                for kind, level in enumerate(block.levels):
                    keys, counts = level.keys, block.counts(kind)
                    yield rows_batch([(kind, number, p, pack(planes(keys[s]), counts[s].astype(np.int32))) for p, s in part_slices(keys, parts)])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a part's counts up. Rows out: replies (block >= 0), the table (-1) and its sums (-2)."""
    for (kind, part), rows in grouped(batches, "kind", "part"):
        rows.sort(key=lambda r: r["block"])
        sent = [unpack(r["payload"]) for r in rows]
        keys = [from_planes(k) for k, _ in sent]
        every, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([c for _, c in sent]), minlength=len(every)).astype(np.int64)
        owner = np.zeros(len(at), np.int64)
        owner[first] = 1  # the first block that has a key speaks for it in the backoff sums
        reply = 2 * counts[at] + owner
        out, start = [], 0
        for r, k in zip(rows, keys):
            mine = reply[start : start + len(k)]
            out.append((kind, r["block"], part, pack(mine.astype(np.uint32 if mine.max(initial=0) < 1 << 32 else np.uint64))))
            start += len(k)
        known = counts > 0
        few = np.bincount(np.minimum(counts[known], K + 2), minlength=K + 3)
        sums = [*few[: K + 2].tolist(), int(counts[counts > K].sum()), int(counts.sum()), int(known.sum())]
        out.append((kind, -1, part, pack(planes(every[known]), counts[known])))
        out.append((kind, -2, part, np.array(sums, "<i8").tobytes()))
        for k in range(0, len(out), 256):
            yield rows_batch(out[k : k + 256])


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32) if x.max(initial=0) < 1 << 31 else x


def _backoff_rows(model: KatzModel, number: int, parts: int, level: int, grams: Grams, counts: list[np.ndarray], own: np.ndarray, end: int) -> Iterator[tuple]:
    """Of each owned gram, under its context: its count and its shorter gram's, as counts of counts."""
    h, r, low = grams.context[own], counts[level - 1][own], counts[level - 2][grams.lower[own]]
    size = len(grams.context_keys)
    sums = np.zeros((size, 2 * K + 2), np.int64)
    for k in range(1, K + 1):
        sums[:, k - 1] = np.bincount(h[r == k], minlength=size)
        sums[:, K + k] = np.bincount(h[low == k], minlength=size)
    sums[:, K] = np.bincount(h, weights=np.where(r > K, r, 0), minlength=size)
    sums[:, 2 * K + 1] = np.bincount(h, weights=np.where(low > K, low, 0), minlength=size)
    c = grams.context_counts(counts, level, end)
    below = np.full(size, model.tokens, np.int64)
    if level > 2:
        below[h] = grams.below.context_counts(counts, level - 1, end)[grams.lower_context[own]]
    some = np.flatnonzero(sums[:, : K + 1].any(1))
    some = some[np.argsort(grams.context_keys[some], kind="stable")]
    for p, s in part_slices(grams.context_keys[some], parts):
        at = some[s]
        yield 2 * level, number, p, pack(planes(grams.context_keys[at]), _small(c[at]), _small(below[at]), _small(sums[at].T))


def _score(model: KatzModel, parts: int) -> Callable:
    """Scores a block as far as it can; rows out: its state (kind 0), and per order its backoff sums (even) and needs (odd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), rows in grouped(batches, "block"):
            block = Block(next(r["payload"] for r in rows if r["kind"] == -1), model.order)
            told = [np.concatenate([unpack(r["payload"])[0] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])]).astype(np.int64) for kind in range(model.order)]
            del rows
            counts = [t >> 1 for t in told]
            c, cur = counts[0], block.cur
            doc = np.repeat(np.arange(len(block.lens)), block.lens)
            add = lambda v: np.bincount(doc, weights=v, minlength=len(block.lens))
            known = add((c > 0)[cur]).astype(np.int64)
            base = add(np.log10((c + 1) / (model.tokens + model.types + 1))[cur])
            # The longest seen gram of each token tells its probability; the unseen ones above it back off.
            p, open_ = np.log10(model.unigram(c))[cur], np.ones(len(cur), bool)
            needs, out = [], []
            for level in range(model.order, 1, -1):
                grams, r = block.levels[level - 1], counts[level - 1]
                contexts = grams.context_counts(counts, level, block.end)
                seen = (r > 0)[grams.at]
                hit = open_ & seen
                ratio = np.log10(model.levels[level - 1](np.maximum(r, 1)) / np.maximum(contexts[grams.context], 1))
                p[hit] = ratio[grams.at[hit]]
                token = np.flatnonzero(open_ & ~seen & (contexts > 0)[grams.context_at])
                open_ &= ~seen
                needed, need = np.unique(grams.context_at[token], return_inverse=True)
                by_key = np.argsort(grams.context_keys[needed], kind="stable")
                place = np.empty(len(by_key), np.int64)
                place[by_key] = np.arange(len(by_key))
                needs.append((level, doc[token].astype(np.int32), place[need].astype(np.int32)))
                keys = grams.context_keys[needed[by_key]]
                out += [(2 * level + 1, number, q, pack(planes(keys[s]))) for q, s in part_slices(keys, parts)]
                own = (told[level - 1] & 1 == 1) & (told[level - 1] > 1)
                out += _backoff_rows(model, number, parts, level, grams, counts, own, block.end)
            out.insert(0, (0, number, -1, pack(block.ids, block.held, block.lens, known, base, add(p), needs)))
            for k in range(0, len(out), 256):
                yield rows_batch(out[k : k + 256])

    return run


def _weigh(model: KatzModel) -> Callable:
    """Backoff weights of a part's contexts. Rows out, by order: replies (block >= 0) and the table (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in grouped(batches, "part"):
            out = []
            for level in range(2, model.order + 1):
                given = [unpack(r["payload"]) for r in rows if r["kind"] == 2 * level]
                asked = sorted((r for r in rows if r["kind"] == 2 * level + 1), key=lambda r: r["block"])
                if not given and not asked:
                    continue
                keys = [from_planes(g[0]) for g in given] or [np.empty(0, np.uint64)]
                every, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                c, below = (np.concatenate([g[k] for g in given]).astype(np.int64)[first] if given else np.empty(0, np.int64) for k in (1, 2))
                sums = np.zeros((2 * K + 2, len(every)), np.int64)
                for k in range(2 * K + 2) if given else ():
                    np.add.at(sums[k], at, np.concatenate([g[3][k] for g in given]))
                alpha = model.alpha(level, c, below, sums)
                out.append((level, -1, part, pack(planes(every), c, alpha)))
                for r in asked:
                    want = from_planes(unpack(r["payload"])[0])
                    out.append((level, r["block"], part, pack(alpha[np.searchsorted(every, want)])))
            for k in range(0, len(out), 256):
                yield rows_batch(out[k : k + 256])

    return run


def _finish(model: KatzModel) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "block"):
            ids, held, lens, known, base, score, needs = unpack(next(r["payload"] for r in rows if r["part"] == -1))
            for level, doc, need in needs:
                replies = sorted((r for r in rows if r["kind"] == level and r["part"] >= 0), key=lambda r: r["part"])
                if replies:
                    alpha = np.log10(np.concatenate([unpack(r["payload"])[0] for r in replies]))
                    score = score + np.bincount(doc, weights=alpha[need], minlength=len(lens))
            cols = [ids, held, lens, known, np.full(len(lens), model.tokens), base, score]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, OUT_KINDS)], [x.split(" ")[0] for x in OUT.split(", ")])

    return run


def places(groups: int) -> int:
    """Partitions for so many groups: a group each, up to a number that a cluster can plan; beyond it a partition holds several, sorted."""
    return min(groups, MOST_PARTITIONS)


class KatzScores:
    """Scores of all documents, and the stored model tables (packed by part): counts and weights."""

    def __init__(self, docs: DataFrame, held_out_mod: int = 7, held_out: int = 2, order: int = ORDER, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS, least_parts: int = LEAST_PARTS):
        held = F.coalesce(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), held_out_mod) == held_out), F.lit(False))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(least_parts, -(-chars // part_chars))
        self.blocks = stored(rows.mapInArrow(_blocks(block_chars), MIXED), "katz-blocks")
        sent = self.blocks.mapInArrow(_requests(parts, order), MIXED)
        dealt = sent.repartition(places(order * parts), "kind", "part").sortWithinPartitions("kind", "part")
        self.counts = stored(dealt.mapInArrow(_count, MIXED), "katz-counts")
        sums = self.counts.where("block = -2").mapInArrow(_unpacked_sums, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect()
        n = np.zeros((order, K + 5), np.int64)
        for s in sums:
            n[s["kind"], s["at"]] = s["n"]
        # Per order: types seen 0..K+1 times, sum of counts over K, tokens, types.
        self.model = KatzModel([np.concatenate([x[: K + 2], x[K + 2 : K + 3]]) for x in n], int(n[0, K + 3]), int(n[0, K + 4]))
        met = self.blocks.unionByName(self.counts.where("block >= 0")).repartition(places(parts), "block").sortWithinPartitions("block", "kind", "part")
        self.states = stored(met.mapInArrow(_score(self.model, parts), MIXED), "katz-states")
        drop_stored(self.blocks)
        asked = self.states.where("part >= 0").repartition(places(parts), "part").sortWithinPartitions("part", "kind", "block")
        self.weights = stored(asked.mapInArrow(_weigh(self.model), MIXED), "katz-weights")
        self.parts = parts

    def scores(self) -> DataFrame:
        both = self.states.where("part = -1").unionByName(self.weights.where("block >= 0"))
        return both.repartition(places(self.parts), "block").sortWithinPartitions("block", "kind", "part").mapInArrow(_finish(self.model), OUT)

    def table(self, kind: int) -> DataFrame:
        """key and count of all words (0), pairs (1) or longer grams of the training texts."""
        return self.counts.where((F.col("block") == -1) & (F.col("kind") == kind)).mapInArrow(_unpacked_table, "key long, count long")

    def backoff(self, level: int = 2) -> DataFrame:
        """key, count and alpha of every context of an order."""
        return self.weights.where((F.col("block") == -1) & (F.col("kind") == level)).mapInArrow(_unpacked_weights, "key long, count long, alpha double")

    def save(self, path: str) -> None:
        """The model as tables of plain columns, by part of the key: counts-1, .. (key, count) and backoff-2, .. (key, count, alpha)."""
        part = F.shiftrightunsigned("key", 56).cast("int").alias("part")
        tables = {f"counts-{k + 1}": self.table(k) for k in range(self.model.order)} | {f"backoff-{k}": self.backoff(k) for k in range(2, self.model.order + 1)}
        for name, df in tables.items():
            df.select("*", part).write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")

    def drop(self) -> None:
        for df in (self.counts, self.states, self.weights):
            drop_stored(df)


def _unpacked_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            n = np.frombuffer(r["payload"], "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([r["kind"]] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32()), pa.array(n)], ["kind", "at", "n"])


def _unpacked_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            keys, counts = unpack(r["payload"])
            yield pa.RecordBatch.from_arrays([pa.array(from_planes(keys).view(np.int64)), pa.array(counts)], ["key", "count"])


def _unpacked_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            keys, counts, alpha = unpack(r["payload"])
            yield pa.RecordBatch.from_arrays([pa.array(from_planes(keys).view(np.int64)), pa.array(counts), pa.array(alpha)], ["key", "count", "alpha"])


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """The scores of all documents; what they were made from goes."""
    model = KatzScores(docs, **options)
    out = stored(model.scores(), "katz-scores")
    model.drop()
    return out
