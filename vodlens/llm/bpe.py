"""BPE encoding and decoding: a segment tree over adjacent pair ranks.

A word's leaves hold the rank of the pair that starts at each symbol, joined with the position, so
the root is the leftmost pair of lowest rank. A merge changes three leaves, each in logarithmic
time, until the root says that no pair can merge. A run of n symbols thus costs O(n log n), also
where a text is one unbroken word.

Defined results: a null text counts as empty; an empty text has no ids and the digest of no bytes;
strings of special tokens in a text become those tokens, as the tokenizers library does by default;
repeated rows and ties give one row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.llm.common import freed

#: Fixed values of the byte-level format: the pattern that splits a text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per generation in a worker's cache, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 120_000, 48
#: A space beside other white space.
BESIDE = re.compile(r" \s|\s ")
#: Characters of text that are split into words at once.
PART_CHARS = 1_000_000
NONE = 1 << 62
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Recent:
    """A cache in two generations: what the full older one held and nobody asked for again goes."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def all_of(self, keys: set[str], make: Callable[[set[str]], dict[str, bytes]]) -> dict[str, bytes]:
        """The values of all keys; make gives those of unknown ones."""
        young, old = self.young, self.old
        unknown = keys.difference(young)
        found = {k: old[k] for k in unknown if k in old}
        found |= make(unknown.difference(found))
        short = {k: v for k, v in found.items() if len(k) <= CACHE_CHARS}
        if len(young) + len(short) > CACHE_WORDS:
            known = {k: young[k] for k in keys if k in young} | found
            self.old, self.young = young, short
            return known
        if len(short) < len(found):
            return {k: young[k] for k in keys if k in young} | found
        young.update(short)
        return young


class ByteBpe:
    """A byte-level BPE vocabulary: encode and decode of whole texts."""

    def __init__(self, spec: dict):
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level vocabularies without normalizer or prefix space")
        model = spec["model"]
        unlike = [k for k in ("ignore_merges", "dropout", "unk_token", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if not spec["pre_tokenizer"].get("use_regex", True):
            unlike.append("use_regex: false")
        if unlike:
            raise ValueError(f"the vocabulary's {', '.join(unlike)} would give other ids, which is not supported")
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.width = max(vocab.values(), default=0) + 1
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[a] * self.width + vocab[b]] = (rank, vocab[a + b])
        self.keys = np.array(sorted(self.pairs), np.int64) if self.pairs else np.array([-1])
        self.rank = np.array([self.pairs.get(k, (NONE, -1))[0] for k in self.keys.tolist()], np.int64)
        self.into = np.array([self.pairs.get(k, (NONE, -1))[1] for k in self.keys.tolist()], np.int64)
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        for t in spec.get("added_tokens", []):
            if any(t.get(flag) for flag in ("lstrip", "rstrip", "single_word")):
                raise ValueError(f"the added token {t['content']!r} takes in what is around it, which is not supported")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(SPLIT)
        by_length = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.words, self.chunks = Recent(), Recent()

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.first[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        pairs, width = self.pairs, self.width
        base = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * base)
        for i in range(n - 1):
            if pair := pairs.get(ids[i] * width + ids[i + 1]):
                tree[base + i] = pair[0] << 32 | i
        for k in range(base - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left < right else right
        after, before, last = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while (root := tree[1]) != NONE:
            i = root & 0xFFFFFFFF
            gone = after[i]
            ids[i] = pairs[ids[i] * width + ids[gone]][1]
            ids[gone] = -1
            after[i] = follow = after[gone]
            if follow < last:
                before[follow] = i
            changed = [(gone, NONE)] if gone < n - 1 else []
            for at in (before[i], i):
                if at >= 0:
                    pair = pairs.get(ids[at] * width + ids[after[at]]) if after[at] < last else None
                    if at < n - 1:
                        changed.append((at, pair[0] << 32 | at if pair else NONE))
            for at, key in changed:
                k = base + at
                if tree[k] == key:
                    continue
                tree[k] = key
                while k > 1:
                    other = tree[k ^ 1]
                    if other < key:
                        key = other
                    k >>= 1
                    if tree[k] == key:
                        break
                    tree[k] = key
        return [x for x in ids if x >= 0]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair cannot merge) and merged id of many pairs."""
        keys = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.rank[at], NONE), self.into[at]

    def merge_many(self, words: list[bytes], base: int) -> list[bytes]:
        """merge() for many words of 2 to base + 1 bytes at once: a row of the matrix is a word's tree."""
        count, size = len(words), base + 1
        lens = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(count, size)
        ids = np.asarray(self.first, np.int64)[raw]
        place = np.arange(size)
        ids[place >= lens[:, None]] = -1
        tree = np.full((count, 2 * base), NONE, np.int64)
        rank, _ = self.ranks(ids[:, :-1], ids[:, 1:])
        tree[:, base:] = np.where((rank < NONE) & (ids[:, 1:] >= 0), rank << 32 | place[:-1], NONE)
        for k in range(base - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after, before = np.tile(place + 1, (count, 1)), np.tile(place - 1, (count, 1))
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            i = tree[rows, 1] & 0xFFFFFFFF
            gone = after[rows, i]
            _, ids[rows, i] = self.ranks(ids[rows, i], ids[rows, gone])
            ids[rows, gone] = -1
            follow = after[rows, gone]
            after[rows, i] = follow
            inner = follow < lens[rows]
            before[rows[inner], follow[inner]] = i[inner]
            self.__update(tree, base, rows, gone, np.full(len(rows), NONE))
            for at in (i, before[rows, i]):
                there = at >= 0
                row, at = rows[there], at[there]
                right = after[row, at]
                inside = right < lens[row]
                rank, _ = self.ranks(ids[row, at], ids[row, np.where(inside, right, 0)])
                self.__update(tree, base, row, at, np.where(inside & (rank < NONE), rank << 32 | at, NONE))
            rows = rows[tree[rows, 1] < NONE]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<u4").tobytes(), (4 * kept.sum(1).cumsum()).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def __update(tree: np.ndarray, base: int, rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
        leaf = at < base
        rows, node, keys = rows[leaf], base + at[leaf], keys[leaf]
        tree[rows, node] = keys
        while node.size and node[0] > 1:  # all leaves are at one depth
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The packed ids of words, through merge_many where a word is short enough."""
        out: dict[str, bytes] = {}
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            if len(raw) < 2 or len(raw) > 65:
                out[word] = np.asarray(self.merge(raw), "<u4").tobytes()
            else:
                sized.setdefault(max(4, 1 << (len(raw) - 2).bit_length()), []).append((word, raw))
        for base, group in sized.items():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                out.update(zip([w for w, _ in part], self.merge_many([r for _, r in part], base)))
        return out

    def pack_words(self, split: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are split into words."""
        known = self.words.all_of({w for words in split for w in words}, self.learn)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def pack_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """The packed ids of chunks between single spaces; one that starts with a space begins a text."""
        names = list(chunks)
        return dict(zip(names, self.pack_words([self.split.findall(c[1:] if c[:1] == " " else " " + c) for c in names])))

    def pack_plain(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts without special tokens.

        A single space between other than white space always starts a word, so such texts are cut
        at spaces, and what lies between is looked up whole; other texts are matched word by word.
        """
        out: list[bytes] = [b""] * len(texts)
        split, whole, loose = {}, {}, {}
        for k, text in enumerate(texts):
            if BESIDE.search(text) or text[:1] == " " or text[-1:] == " ":
                loose[k] = self.split.findall(text)
            elif text:
                split[k] = text.split(" ")
                split[k][0] = " " + split[k][0]
        whole = self.chunks.all_of({c for chunks in split.values() for c in chunks}, self.pack_chunks)
        for k, chunks in split.items():
            out[k] = b"".join(map(whole.__getitem__, chunks))
        for k, packed in zip(loose, self.pack_words(list(loose.values()))):
            out[k] = packed
        return out

    def pack_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[str] = []
        plan: list[list[int | bytes]] = []
        for text in texts:
            own: list[int | bytes] = []
            start = 0
            for m in self.marks.finditer(text) if self.marks is not None and any(s in text for s in self.special) else ():
                own += [len(pieces), np.array([self.special[m[0]]], "<u4").tobytes()]
                pieces.append(text[start : m.start()])
                start = m.end()
            own.append(len(pieces))
            pieces.append(text[start:] if start else text)
            plan.append(own)
        packed = self.pack_plain(pieces)
        return [b"".join(packed[x] if isinstance(x, int) else x for x in own) for own in plan]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack_all([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(spec: str) -> ByteBpe:
    """One vocabulary and its caches per worker process; a task drops them when it ends."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(json.loads(spec))
    return _LOADED[key]


def parts(bpe: ByteBpe, column: pa.Array) -> Iterator[bytes]:
    """The packed ids of a column of texts, worked on in parts of bounded size."""
    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= PART_CHARS:
            yield from bpe.pack_all(texts)
            texts, size = [], 0
    yield from bpe.pack_all(texts)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, vocabulary: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers),
    decoded_sha256, and with keep_ids also ids and the decoded text. The vocabulary file (a few MB,
    read on the driver) goes to the executors as one broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = SCHEMA + (", ids array<long>, decoded string" if keep_ids else "")

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            _LOADED.clear()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for packed in parts(bpe, batch.column(1)):
                ids = np.frombuffer(packed, "<u4").tolist()
                raw = bpe.decode_bytes(ids)
                try:
                    raw.decode()
                except UnicodeDecodeError:
                    raw = raw.decode("utf-8", "replace").encode()
                cols[0].append(len(ids))
                cols[1].append(hashlib.sha256(packed).hexdigest())
                cols[2].append(hashlib.sha256(raw).hexdigest())
                if keep_ids:
                    cols[3].append(ids)
                    cols[4].append(raw.decode())
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
