"""Katz scores against a plain version written from the definition; stored tables; blocks that stay what they are."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vodlens.llm import katz

REST = 1e-6
K = 5
END = "\n"


def words(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [*[w for w in out.split(" ") if w], END]


def good_turing(counts):
    """d(r) for r up to K by Katz's formula, absolute discounting where it gives no discount."""
    n = Counter(counts)
    out = {}
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - absolute) / r
    return lambda r: out[r] if r <= K else 1 - REST


def plain_scores(texts, held, order=2):
    train = [words(t) for i, t in texts.items() if not held(i)]
    grams = [Counter() for _ in range(order)]
    contexts = [Counter() for _ in range(order)]
    for ws in train:
        for i in range(len(ws)):
            padded = [END] * (order - 1) + ws
            for k in range(order):
                g = tuple(padded[i + order - 1 - k : i + order])
                grams[k][g] += 1
                contexts[k][g[:-1]] += 1
    total = sum(grams[0].values())
    d = [good_turing(g.values()) for g in grams]
    unknown = 1 - sum(d[0](c) * c / total for c in grams[0].values()) if total else 1.0

    def seen_p(g):
        return d[len(g) - 1](grams[len(g) - 1][g]) * grams[len(g) - 1][g] / contexts[len(g) - 1][g[:-1]]

    alpha = [None] + [defaultdict(lambda: 1.0) for _ in range(order - 1)]
    for k in range(1, order):
        under = defaultdict(list)
        for g in grams[k]:
            under[g[:-1]].append(g)
        for h, gs in under.items():
            alpha[k][h] = (1 - sum(seen_p(g) for g in gs)) / (1 - sum(seen_p(g[1:]) for g in gs))

    def log_p(g):
        if g in grams[len(g) - 1]:
            return math.log10(seen_p(g))
        return math.log10(alpha[len(g) - 1][g[:-1]]) + log_p(g[1:]) if len(g) > 1 else math.log10(unknown)

    def score(text):
        ws = words(text)
        padded = [END] * (order - 1) + ws
        return sum(log_p(tuple(padded[i : i + order])) for i in range(len(ws)))

    return {i: score(t) for i, t in texts.items()}


def made(seed):
    r = random.Random(seed)
    pool = [f"w{k}" for k in range(120)]
    text = lambda: " ".join(r.choices(pool, [1 / (k + 1) for k in range(120)], k=r.randrange(0, 80)))
    return {i: text() for i in range(150)} | {200: "never seen words here", 201: "", 202: None, 203: "W0 w0\tw1"}


@pytest.mark.parametrize("options", [{}, {"block_chars": 900, "part_chars": 300}, {"order": 3, "block_chars": 900, "part_chars": 300}, {"order": 4}])
def test_scores_equal_a_plain_version(spark, options):
    texts = made(7)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = plain_scores(texts, held, options.get("order", 2))
    rows = katz.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **options).collect()
    assert {r.doc_id for r in rows} == set(want)
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9), r.doc_id


def test_shuffled_input_and_repeated_runs(spark):
    """Blocks are written once with their numbers, whatever order the rows come in."""
    texts = made(8)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    runs = [sorted((r.doc_id, round(r.score, 9)) for r in katz.score_documents(df, block_chars=700).collect()) for df in (docs, docs.repartition(5), docs.orderBy(F.rand()))]
    assert runs[0] == runs[1] == runs[2]


def test_saved_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b a")], "doc_id long, text string")
    model = katz.KatzScores(docs, held_out_mod=10**9)
    model.save(str(tmp_path))
    assert sorted(r["count"] for r in spark.read.parquet(f"{tmp_path}/counts-1").collect()) == [2, 2, 3]
    assert sorted(r["count"] for r in spark.read.parquet(f"{tmp_path}/counts-2").collect()) == [1, 1, 1, 2, 2]
    assert spark.read.parquet(f"{tmp_path}/backoff-2").where("alpha > 0").count() == 3
    model.drop()


def test_few_partitions_for_many_parts(spark, data, monkeypatch):
    d = spark.read.parquet(f"{data}/documents.parquet")
    want = {r.doc_id: (r.score, r.base_score) for r in katz.score_documents(d).collect()}
    monkeypatch.setattr(katz, "MOST_PARTITIONS", 3)
    few = katz.KatzScores(d, block_chars=20_000, part_chars=10_000)
    assert few.parts > 30 and few.counts.rdd.getNumPartitions() <= 4
    got = {r.doc_id: (r.score, r.base_score) for r in few.scores().collect()}
    assert got.keys() == want.keys() and all(abs(got[k][j] - want[k][j]) <= 1e-9 * abs(want[k][j]) for k in want for j in (0, 1))
    few.drop()
