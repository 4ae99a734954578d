"""The seeds of vodlens.llm.decontaminate meet every placement of the changes that verification allows."""

from itertools import combinations
from math import ceil
from random import Random

import pytest

from vodlens.llm import decontaminate as D

KEPT = [sum(1 << p for p in mask) for mask in D.MASKS]


def fits(changed, size):
    return any(not changed & (m << k) for k in range(size - D.SPAN + 1) for m in KEPT)


@pytest.mark.parametrize("size", range(8, 19))
def test_every_placement(size):
    allowed = size - ceil(size * D.SIMILARITY)
    assert all(fits(sum(1 << p for p in c), size) for c in combinations(range(size), allowed))


def fewest_changes(most):
    """For each size, the fewest changed words that leave no seed: over the last SPAN - 1 words' changes."""
    best, out = {0: 0}, []
    for k in range(most):
        fresh = {}
        for tail, n in best.items():
            for bit in (0, 1):
                window = tail | bit << (D.SPAN - 1)
                if k < D.SPAN - 1 or all(window & m for m in KEPT):
                    fresh[window >> 1] = min(fresh.get(window >> 1, 1 << 30), n + bit)
        best = fresh
        out.append(min(best.values()))
    return dict(enumerate(out, 1))


def test_longer_items():
    fewest = fewest_changes(400)
    assert all(fewest[n] > n - ceil(n * D.SIMILARITY) for n in range(8, 401))
    assert fewest[D.RUN] > D.RUN - ceil(D.RUN * D.SIMILARITY)


@pytest.mark.parametrize("max_broadcast", [D.MAX_BROADCAST, 0])
def test_run_with_two_changes(spark, max_broadcast):
    item = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(["x"] * 5 + ["y" if p in c else w for p, w in enumerate(item[8:21])] + ["z"] * 5)) for k, c in enumerate(combinations(range(13), 2))]
    short = [(1000 + k, " ".join("y" if p == k else f"s{p}" for p in range(8))) for k in range(8)]
    docs = spark.createDataFrame(rows + short, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(f"s{p}" for p in range(8)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench, max_broadcast=max_broadcast).collect()}
    assert got == {(k, 1) for k, _ in rows} | {(k, 2) for k, _ in short}


def aligned(doc, item):
    """Brute force: some alignment has RUN neighbouring words (or the whole item) with enough of them equal."""
    n = len(item)
    span = min(D.RUN, n)
    for diagonal in range(-n + 1, len(doc)):
        equal = [0 <= diagonal + k < len(doc) and doc[diagonal + k] == w for k, w in enumerate(item)]
        if n < D.LEAST:
            if all(equal):
                return True
        elif sum(equal) >= n * D.SIMILARITY or any(sum(equal[s : s + span]) >= ceil(span * D.SIMILARITY) for s in range(n - span + 1)):
            return True
    return False


@pytest.mark.parametrize("max_broadcast", [D.MAX_BROADCAST, 0])
def test_recall_against_all_alignments(spark, max_broadcast):
    """Items of 1 to 30 words in documents with up to a third of the words changed, moved and cut: every alignment is found."""
    r = Random(8)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 31)} | {40: ["the"] * 20, 41: ["a", "b"] * 12}
    docs = {}
    for n, words in items.items():
        for _ in range(12):
            text = [w if r.random() < 0.8 else "x" for w in words]
            cut = r.randrange(3)
            docs[len(docs)] = [f"f{r.randrange(99)}" for _ in range(r.randrange(6))] + text[cut:] + ["end"] * r.randrange(3)
        docs[len(docs)] = ["before", *words, "after"]
    docs[len(docs)] = ["the"] * 300
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.contaminated(d, bench, max_broadcast=max_broadcast).collect()}
    assert got == {(i, j) for i, w in docs.items() for j, v in items.items() if aligned(w, v)}


def test_hits_are_distinct_before_they_are_compared(spark):
    """A repetitive text against a repetitive item: as many comparisons as diagonals."""
    d = spark.createDataFrame([(1, "the " * 400)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the " * 50)], "item_id long, text string")
    assert D.hits_of(d, bench).count() <= 450


def test_short_items_with_one_change(spark):
    """Items of 5 to 7 words: each word changed, the ends cut off by the text's own ends, and two changes, which are too many."""
    bench, docs, want = [], [], set()
    for n in (4, 5, 6, 7):
        words = [f"s{n}w{k}" for k in range(n)]
        bench.append((n, " ".join(words)))
        for k in range(n):
            for text in (["x", *words[:k], "new", *words[k + 1 :], "y"], [*words[:k], "new", *words[k + 1 :]]):
                docs.append((len(docs), " ".join(text)))
                want |= {(len(docs) - 1, n)} if n >= D.LEAST else set()
        for text in (words[1:], words[:-1], ["z", *words[:-1]], [*words[1:], "z"]):
            docs.append((len(docs), " ".join(text)))
            want |= {(len(docs) - 1, n)} if n >= D.LEAST else set()
        docs.append((len(docs), " ".join(["new", *words[1:-1], "new"])))
        docs.append((len(docs), " ".join(words)))
        want.add((len(docs) - 1, n))
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
