"""Edge cases of every operator: nulls, empty and very long texts, ties, repeats, empty tables, extra columns."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vodlens.llm import bpe, common, decontaminate, html_extract, html_pages, katz, line_dedup, quality, simhash, topk, url_rules, warc
from vodlens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, key string, quality int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "extra", "extra", 7) for i, t in rows], DOCS)


LONG = "alpha beta gamma delta " * 20_000
ODD = [(1, None), (2, ""), (None, "no id here"), (None, None), (3, "same text"), (3, "same text"), (4, "same text"), (5, LONG), (6, " \t\n ")]
OPERATORS = {
    "quality": lambda s, d: quality.score(d, quality.fit_texts(["a good text"] * 4, ["BAD!! TEXT!!"] * 4)),
    "keep_good": lambda s, d: quality.keep_good(d, quality.fit_texts(["a good text"] * 4, [])),
    "katz": lambda s, d: katz.score_documents(d),
    "decontaminate": lambda s, d: decontaminate.clean(d, s.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string")),
    "simhash": lambda s, d: simhash.fingerprint_table(d),
    "lines": lambda s, d: line_dedup.line_digests(d),
    "drop_lines": lambda s, d: line_dedup.drop_frequent_lines(d),
    "bpe": lambda s, d: bpe.encode_decode(d, bpe.default_vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_rows(spark, name):
    assert len(OPERATORS[name](spark, docs(spark, *ODD)).collect()) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark)).collect() == []


def test_quality_without_labels(spark):
    d = docs(spark, (1, "text"), (2, None))
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(d, quality.fit(d, none)).collect()} == {0.5}
    assert quality.fit_texts(["x"], []).scores(["y"]).tolist() == [1.0] and quality.fit_texts([], ["x"]).scores(["y"]).tolist() == [0.0]


def test_quality_tells_shouting(spark):
    good = [f"the quick brown fox number {k} walks over the hill and rests" for k in range(400)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    model = quality.fit_texts(good, bad)
    assert model.scores(["the quick brown fox number 999 walks over the hill and rests"])[0] > 0.7 > 0.3 > model.scores(["THE!! QUICK!! BROWN!! FOX!! NUMBER!! 999!! WALKS!! OVER!! THE!! HILL!!"])[0]


def test_html_cases():
    m = html_extract.default_model()
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One  two\n three.<p>Four&nbsp;<b>five</b>, six.<script>var p = '<p>no</p>';</script></p><!-- <p>no</p> --></article><aside><p>More to read here.</p></aside><div class=comments><p>I think that this is great.</p></div><form><p>Sign up.</p></form><footer>&copy; me</footer></body></html>"
    assert m.extract(page) == "A & B\n\nOne two three.\n\nFour five, six."
    assert m.extract(None) == m.extract("") == m.extract("<nav><a>x</a></nav>") == ""
    deep = "<div>" * 5000 + "<p>text</p>"
    assert isinstance(m.extract(deep), str)
    assert isinstance(m.extract("<p " + '"' * 3000 + "<" * 3000), str)


def test_html_marginals_equal_brute_force():
    from itertools import product

    m = html_extract.default_model()
    tree = html_extract.parse("<body><div class=content><p>Some words here.</p></div><nav><a href=x>y</a></nav></body>")
    n = len(tree.tag)
    phi = [m.potential(html_extract.features(tree, k)) for k in range(n)]
    total = np.zeros((n, 3))
    for states in product(range(3), repeat=n):
        p = m.root[states[0]] * math.prod(phi[k][s] for k, s in enumerate(states)) * math.prod(m.turn[states[tree.parent[k]]][states[k]] for k in range(1, n))
        for k, s in enumerate(states):
            total[k, s] += p
    assert np.allclose(m.marginals(tree), total / total.sum(1, keepdims=True))


def test_html_held_out_pages():
    m, maker = html_extract.default_model(), html_pages.Maker(987)
    right = total = 0
    for _ in range(60):
        tree = html_extract.parse(maker.page(), labels=True)
        for label, text, p in zip(tree.label, tree.text, m.marginals(tree)):
            if text is not None:
                total += 1
                right += (label == "c") == (p[0] == max(p))
    assert right / total > 0.97


def test_katz_is_normalised(spark):
    d = docs(spark, *[(k, t) for k, t in enumerate(["a b c", "a b d", "b a", "c c c c", "the cat", "a b c d e f g"] * 3)])
    scores = katz.KatzScores(d, held_out_mod=10**9)
    model = scores.model
    words = {r.key: r["count"] for r in scores.table(katz.WORDS).collect()}
    pairs = {r.key: r["count"] for r in scores.table(katz.PAIRS).collect()}
    backoff = {r.key: r for r in scores.backoff().collect()}
    p = {w: float(model.unigram(np.array([c]))[0]) for w, c in words.items()}
    unknown = float(model.unigram(np.array([0]))[0])
    assert sum(p.values()) + unknown == pytest.approx(1, abs=1e-12) and unknown > 0
    u = lambda x: np.array([x], np.int64).view(np.uint64)
    for h, row in backoff.items():
        total = row.alpha * unknown
        for w in words:
            r = pairs.get(int(katz.mixed(u(h), u(w)).view(np.int64)[0]))
            total += float(model.pairs(np.array([r]))[0]) / row["count"] if r else row.alpha * p[w]
        assert total == pytest.approx(1, abs=1e-12)
    assert sum(words.values()) == model.tokens and len(words) == model.types


def test_katz_blocks_and_parts_do_not_matter(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    runs = [{r.doc_id: (r.score, r.base_score) for r in katz.KatzScores(d, **o).scores().collect()} for o in ({}, {"block_chars": 20_000, "part_chars": 10_000})]
    assert runs[0].keys() == runs[1].keys() and all(np.allclose(runs[0][k], runs[1][k], rtol=1e-12) for k in runs[0])


def test_katz_without_training(spark):
    rows = katz.KatzScores(docs(spark, (1, "a b"), (2, "")), held_out_mod=1, held_out=0).scores().collect()
    assert [(r.n_known, r.train_tokens, r.score) for r in rows] == [(0, 0, 0.0)] * 2


def test_planes_round_trip():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 999).astype(np.uint64))
    assert (katz.from_planes(katz.planes(keys)) == keys).all() and len(katz.from_planes(katz.planes(keys[:0]))) == 0
    assert (katz.from_int_planes(katz.int_planes(np.arange(70_000))) == np.arange(70_000)).all()


PASSAGE = [f"w{k}" for k in range(30)]


@pytest.mark.parametrize("max_broadcast", [decontaminate.MAX_BROADCAST, 0])
def test_decontamination(spark, max_broadcast):
    bench = spark.createDataFrame([(1, " ".join(PASSAGE)), (2, "too short"), (1, " ".join(PASSAGE))], "item_id long, text string")
    every5 = [w if k % 5 else "x" for k, w in enumerate(PASSAGE)]
    every2 = [w if k % 2 else "x" for k, w in enumerate(PASSAGE)]
    d = docs(spark, (1, "before " + " ".join(PASSAGE).upper() + " after"), (2, " ".join(every5)), (3, " ".join(every2)), (4, "\t".join(PASSAGE[8:22])), (5, " ".join(PASSAGE[:9])), (6, "clean words only " * 9), (None, " ".join(PASSAGE)), (7, "too short"))
    found = decontaminate.contaminated(d, bench, max_broadcast=max_broadcast)
    assert sorted((r.doc_id or 0, r.item_id, r.equal_words) for r in found.collect()) == [(0, 1, 30), (1, 1, 30), (2, 1, 24), (4, 1, 14), (7, 2, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench, max_broadcast=max_broadcast).collect()) == [3, 5, 6]


def brute_components(marks, distance):
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(marks))]


@pytest.mark.parametrize("cell,whole", [(simhash.CELL, None), (16, 3), (simhash.CELL, 6)])
def test_links_connect_what_is_connected(spark, cell, whole):
    rng = np.random.default_rng(3)
    marks = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 60)}
    for x in list(marks)[:12]:  # chains of near copies, some crossing the distance
        for _ in range(12):
            for b in rng.integers(0, 63, rng.integers(1, 5)):
                x ^= 1 << int(b)
            marks.add(x)
    marks = sorted(marks | {0, 1, 3, -1})
    found = components(simhash.links(spark.createDataFrame([(m,) for m in marks], "fp long"), 3, cell, whole))
    roots = {r.node: r.root for r in found.collect()}
    want = brute_components([m & (1 << 64) - 1 for m in marks], 3)
    got = [roots.get(m, m) for m in marks]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_embedding_bounds_the_distance(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(a) ^ int(b)) for a, b in zip(rng.integers(-(1 << 63), 1 << 63, 200), rng.integers(0, 1 << 20, 200))]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(simhash.unary_counts(F.col("a")).bitwiseXOR(simhash.unary_counts(F.col("b")))).alias("low"))
    for r in df.collect():
        segments = lambda x: [(x >> 2 * k & 3).bit_count() for k in range(32)]
        assert r.low == sum(abs(x - y) for x, y in zip(segments(r.a & (1 << 64) - 1), segments(r.b & (1 << 64) - 1))) <= ((r.a ^ r.b) & (1 << 64) - 1).bit_count()


def test_one_of_each_group_stays(spark):
    d = docs(spark, (5, "one two three four"), (3, "one two three four"), (3, "one two three four"), (9, "other words are here now"), (None, "null id text alone"), (2, ""), (1, None))
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(d).collect()) == [0, 1, 3, 9]


def test_warc_files_roll_and_verify(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>{k * 7919}</p>" * 50) for k in range(40)] + [(100, "u", "<p>7919</p>" * 50), (100, "u", "<p>7919</p>" * 50), (None, None, None), (None, "v", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_archives(pages, str(tmp_path / "a"), shard_bytes=4_000, roll_bytes=500)
    files = manifest.collect()
    assert len(files) > 4 and sum(f.records for f in files) == len(rows) and not list((tmp_path / "a").glob("_temporary*"))
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect())
    assert (1, "revisit", 100) in got and got.count((100, "response", None)) == 1 and got.count((100, "revisit", 100)) == 1 and got.count((-1, "response", None)) == 2
    again = warc.write_archives(pages, str(tmp_path / "b"), shard_bytes=4_000, roll_bytes=500)
    assert sorted((f.file.rpartition("/")[2], f.sha256) for f in files) == sorted((f.file.rpartition("/")[2], f.sha256) for f in again.collect())
    path = files[0].file.removeprefix("file://")
    raw = gzip.decompress(open(path, "rb").read())
    open(path, "wb").write(gzip.compress(raw[:-1]))
    with pytest.raises(Exception):
        warc.read_archives(manifest).collect()


def test_warc_minimum_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type) for r in warc.round_trip(pages, min_revisit=5).collect())
    assert got == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]
    assert warc.round_trip(pages.limit(0)).count() == 0


URLS = [None, "", "no scheme", "http://", "https://Example.NET/en/1", "http://a.example.net/fr/", "http://net", "http://net/", "http://x.net?q=/en/", "http://example.com/de", "http://example.com/de/x", "http://sub.example.com/de/#f", "http://example.com:80/de/", "http://notexample.com/de/", "http://w.org/fr/x?y", "http://org/frx", "ftp://a.b/c://d"]


def test_url_rules_two_ways(spark):
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    both = [sorted(map(str, url_rules.judge_urls(pages, url_rules.RULES, max_rules=n).collect())) for n in (url_rules.MAX_RULES, 0)]
    assert both[0] == both[1] and len(both[0]) == len(URLS) + 3
    verdict = {URLS[r.page_id]: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, url_rules.RULES).collect() if r.page_id < len(URLS)}
    assert verdict["https://Example.NET/en/1"] == ("example.net/en/", "allow") and verdict["http://a.example.net/fr/"] == ("net/", "block")
    assert verdict["http://net"] == (None, "allow") and verdict["http://net/"] == ("net/", "block") and verdict["http://x.net?q=/en/"] == (None, "allow")
    assert verdict["http://example.com/de"] == (None, "allow") and verdict["http://sub.example.com/de/#f"] == ("example.com/de/", "block") and verdict[None] == (None, "allow")


def test_url_prefix_inside_a_segment(spark):
    trie = url_rules.RuleTrie([("a.b", "/en", "block"), ("a.b", "/english/x", "allow"), ("a.b", "", "allow")])
    assert trie.match("w.a.b", "/english") == ("a.b/en", "block") and trie.match("a.b", "/english/xy") == ("a.b/english/x", "allow") and trie.match("a.b", "") == ("a.b", "allow")


def test_bands_grow_with_the_table():
    sizes = [simhash.bands_for(10**k, 3) for k in range(3, 12)]
    assert sizes == sorted(sizes) and sizes[0] == 3 and sizes[-1] == 6


def test_long_labelled_texts_take_part(spark):
    good, bad = "the quick brown fox walks over the hill. ", "BUY!! NOW!! CHEAP!! "
    rows = [(k, (good if k % 2 else bad) * (60 + k) * 9) for k in range(80)]
    assert min(len(t) for _, t in rows) < quality.SAMPLE_CHARS < max(len(t) for _, t in rows)
    d = docs(spark, *[(i, t) for i, t in rows if len(t) > quality.SAMPLE_CHARS])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    assert model.constant is None and model.scores([good * 30])[0] > 0.7 > 0.3 > model.scores([bad * 30])[0]
    pieces = d.select(F.length(quality.spaced(F.col("text"))).alias("n")).collect()
    assert {r.n for r in pieces} == {quality.PIECES * (quality.PIECE + 1) - 1}


def test_url_rules_of_equal_length(spark):
    rules = [("a.b", "/cd", "block"), ("x.a.b", "/", "allow"), ("a.b", "/ce", "allow"), ("x.a.b", "/", "block")]
    for order in (rules, rules[::-1]):
        pages = spark.createDataFrame([(1, "http://x.a.b/cd"), (2, "http://y.a.b/cd"), (3, "http://x.a.b/q")], "page_id long, url string")
        both = [sorted(map(tuple, url_rules.judge_urls(pages, order, max_rules=n).collect())) for n in (url_rules.MAX_RULES, 0)]
        last = max((r for r in order if r[0] + r[1] in ("a.b/cd", "x.a.b/")), key=lambda r: (len(r[0] + r[1]), order.index(r) if order.count(r) == 1 else 0))
        assert both[0] == both[1] and both[0][0][3] == last[0] + last[1]
    trie = url_rules.RuleTrie([("a.b", f"/p{k}", "block") for k in range(100_000)])
    assert trie.match("a.b", "/p99999x") == ("a.b/p99999", "block") and len(trie.root["b"]["a"][trie.PATHS][""][trie.SIZES]) == 5


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    sizes = []
    for k in range(5):
        fresh = runs.add(docs(spark, (k, f"common\nline {k}\n COMMON \nline {max(0, k - 1)}")))
        sizes.append(fresh.count())
    assert sizes == [2, 1, 1, 1, 1] and [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.frequent(5).count() == 1 and runs.merged().count() == 6
    runs.drop()


def test_drop_lines(spark):
    rows = [(k, f"Shared line\nown {k}\n\n  shared LINE\t") for k in range(10)] + [(10, None), (11, "shared line"), (12, "\n")]
    kept = {r.doc_id: r.text for r in line_dedup.drop_frequent_lines(docs(spark, *rows), min_docs=11).collect()}
    assert kept[3] == "own 3\n" and kept[10] is None and kept[11] == "" and kept[12] == "\n"
    assert line_dedup.drop_frequent_lines(docs(spark, *rows), min_docs=12).where("doc_id = 3").first().text == rows[3][1]


def test_top_k_edges(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, None), (4, [0.1, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (50, [-0.1, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("q", F.lit(1))
    got = sorted(map(tuple, topk.search(v).collect()))
    assert got == [(0, 1, 1, 25 * 25 + 51 * 51), (0, 2, 2, 25 * 25 + 51 * 51), (0, 3, 50, -26 * 25), (50, 1, 0, -26 * 25), (50, 2, 1, -26 * 25), (50, 3, 2, -26 * 25)]
    assert topk.search(v.limit(0)).count() == 0


def test_top_k_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[200:260] = x[7]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    n = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 400, 10):
        s = n @ n[q]
        order = [k for k in sorted(range(400), key=lambda k: (-s[k], k)) if k != q][:5]
        want += [(q, r + 1, k, int(s[k])) for r, k in enumerate(order)]
    assert sorted(map(tuple, topk.search(v, every=10, block=7, pivots=8).collect())) == want


@pytest.mark.parametrize("text", ["", "hello world", "  two  spaces ", "a<|endoftext|>b", "I'll can't 123abc", "é日本語😀" * 3, "x" * 3000, "tab\there \n\n end", "\u2003wide\u3000", "a\x1c b"])
def test_bpe_equals_the_library(text):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    own, library = bpe.loaded(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_vector_form_equals_the_tree_of_one_word():
    own = bpe.ByteBpe(json.load(open(bpe.default_vocabulary(), encoding="utf-8")))
    words = [bytes(np.random.default_rng(k).integers(32, 127, 2 + k % 60).tolist()) for k in range(300)]
    for w in words:
        assert np.frombuffer(own.learn({w.decode()})[w.decode()], "<u4").tolist() == own.merge(w)


def test_bpe_rejects_what_it_does_not_honour():
    spec = json.load(open(bpe.default_vocabulary(), encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    with pytest.raises(ValueError):
        bpe.ByteBpe(spec)


def test_bpe_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    own = bpe.ByteBpe(json.load(open(bpe.default_vocabulary(), encoding="utf-8")))
    texts = ["the cat sat on the mat", "another line of words", "the cat again", ""] * 3
    assert [own.decode(np.frombuffer(p, "<u4").tolist()) for p in own.pack_all(texts)] == texts


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_root(spark)
    df = common.stored(spark.range(3), "x")
    assert df.count() == 3
    common.drop_stored(df)


@pytest.mark.parametrize("place,flag,value", [("pre_tokenizer", "use_regex", False), ("model", "ignore_merges", True), ("model", "dropout", 0.1), ("model", "unk_token", "<unk>"), ("model", "byte_fallback", True), ("model", "end_of_word_suffix", "</w>")])
def test_bpe_refuses_what_it_would_get_wrong(place, flag, value):
    symbols = bpe.byte_symbols()
    spec = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"vocab": {s: k for k, s in enumerate(symbols)}, "merges": []}}
    assert bpe.ByteBpe(spec).merge(b"ab") == [symbols.index("a"), symbols.index("b")]
    spec[place][flag] = value
    with pytest.raises(ValueError):
        bpe.ByteBpe(spec)


def test_near_copies_odd_rows(spark):
    """Repeated rows, null texts and ids, extra columns: one row of each group stays, as it was."""
    from vodlens.llm import near_copies

    d = docs(spark, *ODD)
    kept = near_copies.one_of_each(d)
    assert kept.columns == d.columns
    rows = sorted(map(tuple, kept.collect()), key=repr)
    every = [tuple(r) for r in d.collect()]
    assert all(r in every for r in rows)
    texts = [(r[1] or "").strip() for r in rows]
    assert sorted(texts) == sorted({(t or "").strip() for _, t in ODD})
    by = {t: r[0] for t, r in zip(texts, rows)}
    assert by["same text"] == 3 and by[""] == 1 and by["no id here"] is None
    assert near_copies.one_of_each(d.limit(0)).collect() == []
