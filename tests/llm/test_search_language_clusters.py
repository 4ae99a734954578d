"""op11, op12 and op13: brute force, held-out accuracy, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vodlens.llm import kmeans, language, queries, ranked

DOCS = "doc_id long, text string, lang string, item_id long, words string, score int, rank int, item string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, g, 9, "x", 1, 1, "y") for i, t, g in rows], DOCS)


def terms(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranking(rows, items, k):
    """Every document scored for every item, in plain Python."""
    bags = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for w, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // total
            s = sum(weight[w] * ((1_000_000_000 * b[w]) // (1000 * b[w] + 12 * m)) for w in terms(text) if b[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_ranking_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)] + ["Été", "ßtraße", "日本語", "it's", "a_b"]
    rows = [(int(k), " ".join(rng.choice(words, int(rng.integers(0, 30)))), "en") for k in range(400)]
    rows += [(1000 + k, "w1 w2 w2 W3 same", "en") for k in range(60)]  # many ties at the k-th place
    rows += [(7, None, "en"), (8, "", "en"), (None, "w1 w2 w3", "en"), (5, "w1 w2 w2 w3 same", "en"), (9, "... !!", "en"), (10, "w4 " * 300_000, "en")]
    items = [(1, "w1 w2 w3 same"), (2, "W5 w5 w6 unknown"), (3, None), (4, ""), (5, "no such words"), (None, "日本語 été ÉTÉ"), (6, "w7"), (6, "w8"), (1, "w1 w2 w3 same")]
    want = ranking([r[:2] for r in rows], list(dict.fromkeys(items)), 20)
    table = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"group": 16, "sample": 50}, {"block": 2}, {"sent_bytes": 20, "sample": 1}):
        got = ranked.rank_documents(docs(spark, *rows).repartition(3), table, **options).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want, options


def test_ranking_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.rank_documents(docs(spark), items).collect() == []
    assert ranked.rank_documents(docs(spark, (1, "a", "en")), items.limit(0)).collect() == []


def test_threshold_stops_before_the_lists_end():
    rng = np.random.default_rng(0)
    n, words = 5_000, 40
    counts = (rng.pareto(1.0, (n, words)) * 3).astype(np.int64)
    counts[:, 0] += 1
    sizes, word = (counts > 0).sum(1), np.nonzero(counts)[1].astype(np.int32)
    scores = ranked.Scores(n, int(counts.sum()), (counts > 0).sum(0))
    group = ranked.Group(np.arange(n), counts.sum(1), sizes, word, counts[counts > 0], scores)
    best, times = ranked.Best(20), np.zeros(words, np.int64)
    times[[0, 3]] = 1
    assert group.search(np.array([0, 3]), times, best) < (counts[:, [0, 3]] > 0).sum() / 2
    every = ranked.Best(20)
    every.add(group.looked_up(np.arange(n), times), np.arange(n))
    assert best.score.tolist() == every.score.tolist() and best.ids.tolist() == every.ids.tolist()


def test_parts_of_texts_do_not_matter(monkeypatch):
    text = "Hello, wörld!! 123 été_x " * 40 + "y" * 500
    words, slots = ranked.counted(text), np.sort(np.concatenate(list(language.slots_of(text))))
    for part in (1, 2, 3, 7, 100):
        monkeypatch.setattr(ranked, "PART", part)
        monkeypatch.setattr(language, "PART", part)
        assert ranked.counted(text) == words
        assert (np.sort(np.concatenate(list(language.slots_of(text)))) == slots).all()


def test_language_held_out(spark, data):
    langs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op12_language(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == langs[r.doc_id][0] for r in rows if r.held_out and langs[r.doc_id][1] and langs[r.doc_id][0]]
    assert sum(judged) / len(judged) > 0.97


def test_codewords():
    for n in (2, 3, 4, 7, 8, 30):
        code = language.codewords(n)
        assert set(np.unique(code)) == {-1, 1} and not (np.abs(code.sum(0)) == n).any()
        apart = (code.shape[1] - code @ code.T) // 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (2 ** (n - 2) if n <= 7 else 8)


def test_decoding_is_the_nearest_codeword():
    code = language.codewords(4)
    model = language.Codes(["a", "b", "c", "d"], code, np.zeros((language.SLOTS, code.shape[1]), np.float32))
    for k in range(4):
        for wrong in range(code.shape[1]):
            heard = code[k] * 3.0
            heard[wrong] *= -1  # one classifier errs: still the same codeword
            plain = [sum(math.log1p(math.exp(-c * h)) for c, h in zip(row, heard)) for row in code]
            loss = model.losses(10, heard)
            assert loss.argmin() == np.argmin(plain) == k and np.allclose(loss * model.apart, plain)


ODD = [(1, None, "en"), (2, "", "en"), (None, "ein text ohne id", "de"), (3, "same text here", "en"), (3, "same text here", "en"), (4, "123 !!", None), (5, "le texte est la " * 30_000, "fr"), (6, " \n", "fr"), (7, "das ist der text", None)]


def test_language_odd_rows(spark):
    d = docs(spark, *ODD, *[(100 + k, f"the text of number {k} and the rest", "en") for k in range(9)], *[(200 + k, f"das ist der text {k} und mehr", "de") for k in range(9)])
    model = language.fit(d)
    rows = language.identify(d, model).collect()
    assert len(rows) == len(ODD) + 18
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (1, 2, 4, 6, 7, 3)] == ["und"] * 4 + ["de", "en"]
    assert language.identify(docs(spark), model).collect() == []


def test_language_with_one_or_none(spark):
    d = docs(spark, *[(k, "some text", "en") for k in range(9)])
    assert {(r.lang_pred, r.score) for r in language.identify(d, language.fit(d)).collect()} == {("en", 1.0)}
    d = docs(spark, (1, "some text", None))
    assert [(r.lang_pred, r.score) for r in language.identify(d, language.fit(d)).collect()] == [("und", 0.0)]
    assert language.fit(docs(spark)).languages == []


def test_weights_equal_brute_force(spark):
    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 9)]
    d = docs(spark, *rows)
    model = language.fit(d)
    shares = np.full((3, language.SLOTS), language.SMOOTH)
    for i, t, g in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            for s in language.slots_of(t):
                np.add.at(shares[["de", "en", "fr"].index(g)], s, 1)
    shares /= shares.sum(1, keepdims=True)
    for b in range(model.code.shape[1]):
        up = model.code[:, b] > 0
        assert np.allclose(model.weights[:, b], np.log(shares[up].mean(0) / shares[~up].mean(0)), atol=1e-5)


def lloyd(rows, k, rounds, seed="2"):
    """Full scans in Python's integers."""
    v = [(i, [kmeans.whole(x) for x in e]) for i, e in rows]
    key = lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cen = [x for _, x in sorted(v, key=key)[:k]]
    for step in range(rounds + 1):
        own = [min(range(len(cen)), key=lambda j: (kmeans.squared(x, cen[j]), j)) for _, x in v]
        if step < rounds:
            for j in range(len(cen)):
                mine = [x for (_, x), a in zip(v, own) if a == j]
                cen[j] = [sum(c) // len(mine) for c in zip(*mine)] if mine else cen[j]
    far = [kmeans.squared(x, cen[a]) for (_, x), a in zip(v, own)]
    sums = Counter()
    for a, d in zip(own, far):
        sums[a] += d
    fit = lambda n: n if n < 1 << 63 else None
    return sorted((i, a, fit(d), fit(sums[a]), fit(sum(far)), hashlib.sha256(",".join(map(str, cen[a])).encode()).hexdigest()) for (i, _), a, d in zip(v, own, far))


VECTORS = "vec_id long, embedding array<double>, cluster int, distance long, vec string, wide int, upper int"


def clusters(spark, rows, **options):
    found = kmeans.cluster(spark.createDataFrame([(i, e, 1, 1, "x", 1, 1) for i, e in rows], VECTORS).repartition(3), **options)
    return sorted(tuple(r)[:6] for r in found.collect()), [r.scans for r in found.collect()]


def test_clusters_equal_full_scans(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 3
    rows = [(k, (centres[k % 6] + rng.normal(size=8) * 0.1).tolist()) for k in range(80)]
    rows += [(1000 + k, [1 / 256] * 8) for k in range(100)]  # copies
    rows += [(2000 + k, [float(k % 3), *[0.0] * 7]) for k in range(30)] + [(5, [2.0] * 8), (5, [2.0] * 8)]  # ties and repeated ids
    got, scans = clusters(spark, rows, clusters=12, rounds=4, length=8)
    assert got == lloyd(rows, 12, 4) and sum(scans) < 5 * len(rows) * 0.9


@pytest.mark.parametrize("size", [1e6, 1e9, 1e200])
def test_clusters_of_large_numbers(spark, size):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=4) * (size if k % 3 == 0 else 1)).tolist()) for k in range(90)]
    got, _ = clusters(spark, rows, clusters=7, rounds=3, length=4)
    assert sorted(got, key=repr) == sorted(lloyd(rows, 7, 3), key=repr)


def test_clusters_of_odd_rows(spark):
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, math.nan]), (5, [math.inf, 1.0]), (6, [1.0]), (None, [1.0, 2.0])]
    good = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-1.5, 0.3])]
    got, _ = clusters(spark, odd + good, length=2)
    assert got == lloyd(good, 40, 5)
    assert clusters(spark, odd, length=2)[0] == []


def test_many_languages(spark):
    """Eighty values of lang, some of them odd: random codewords, all texts told apart by their own letters."""
    names = [f'l"{k}' if k % 7 else f"sprache '{k}" for k in range(80)]
    rows = [(1000 * k + j, " ".join(chr(0x4E00 + 20 * k + (j * i) % 20) * 2 for i in range(1, 12)), g) for k, g in enumerate(names) for j in range(6)]
    d = docs(spark, *rows)
    model = language.fit(d)
    assert len(model.languages) == 80 and model.code.shape == (80, 64)
    got = {r.doc_id: r.lang_pred for r in language.identify(d, model).collect()}
    assert sum(got[i] == g for i, _, g in rows) > 0.95 * len(rows)
