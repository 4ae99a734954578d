"""The registered queries on the smallest tables: SQL where there is some, brute force elsewhere."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from oracle import compare, connection
from vodlens.llm import queries as q

SQL = q.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connection(data)


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, duck, name):
    compare(getattr(q, name)(spark, data), duck, SQL[name])


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 2


def test_op1(spark, data, docs):
    rows = q.op1_quality(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id, 4) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    judged = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in judged if y], [s for s, y in judged if not y]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert not bad or wins / (len(good) * len(bad)) > 0.8


def test_op2(spark, data):
    rows = {r.page_id: r for r in q.op2_html(spark, data).collect()}
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    assert set(rows) == set(pages)
    for k, html in pages.items():
        assert rows[k].n_chars == len(rows[k].text)
        assert "copy;" not in rows[k].text and "©" not in rows[k].text and "track(" not in rows[k].text and rows[k].text


def test_op3(spark, data, docs):
    rows = {r.doc_id: r for r in q.op3_katz(spark, data).collect()}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in docs.items()}
    known = Counter(w for i, ws in tokens.items() if not held(i, 7) for w in ws)
    n, v = sum(known.values()), len(known)
    gain = 0.0
    for i, ws in tokens.items():
        base = sum(np.log10((known[w] + 1) / (n + v + 1)) for w in ws)
        assert rows[i].base_score == pytest.approx(base, rel=1e-9)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens, rows[i].held_out) == (len(ws), sum(w in known for w in ws), n, held(i, 7))
        gain += (rows[i].score - rows[i].base_score) * rows[i].held_out
    assert gain > 0


def test_op4(spark, data, docs):
    got = {(r.doc_id, r.item_id) for r in q.op4_decontaminate(spark, data).collect()}
    flat = {i: " ".join(t.lower().split()) for i, t in docs.items()}
    want = {(i, b.item_id) for b in spark.read.parquet(f"{data}/benchmark.parquet").collect() for i, t in flat.items() if " ".join(b.text.lower().split()) in t}
    assert want and got == want


def fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def test_op5(spark, data, docs):
    rows = {r.doc_id: r for r in q.op5_simhash(spark, data).collect()}
    marks = {i: fingerprint(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in docs:
        for j in docs:
            if i < j and (marks[i] ^ marks[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{marks[i]:016x}", find(i)) for i in docs}


def test_op6(spark, data):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    first = {}
    for i, p in pages:
        first[p] = max(i, first.get(p, i))
    want = sorted((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, p in pages)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in q.op6_warc(spark, data).collect())
    assert got == want


def test_op10(spark, data, docs):
    from tokenizers import Tokenizer

    from vodlens.llm.bpe import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    rows = {r.doc_id: r for r in q.op10_bpe(spark, data).collect()}
    for i, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
