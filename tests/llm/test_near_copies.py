"""The pipeline's near-dedup stage against all pairs' exact similarity."""

import random

import corpus_pipeline
from vodlens.llm import near_copies


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(texts):
    """The smallest id of each component of the pairs at 0.8 or more."""
    sets = {i: shingles(t or "") for i, t in texts.items()}
    left, kept = set(sets), set()
    while left:
        edge = [min(left)]
        kept.add(edge[0])
        while edge:
            i = edge.pop()
            left.discard(i)
            near = [j for j in left if similarity(sets[i], sets[j]) >= 0.8]
            left.difference_update(near)
            edge += near
    return kept


def made(seed=3):
    """Texts with copies of 1 to 3 changed words each (chains too), short texts, empty texts and unrelated ones."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5_000)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(r.randrange(60, 300))]
        texts.append(" ".join(base))
        for _ in range(r.randrange(6)):
            copy = list(base)
            for _ in range(r.randrange(1, 4)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if r.random() < 0.4:
                base = copy
    return dict(enumerate([*texts, "a b", "A  B", "a c", "", None, " "]))


def test_stage_finds_what_all_pairs_find(spark):
    texts = made()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()} == expected(texts)


def test_stage_on_the_smallest_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.drop_copies(spark, docs, data)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == expected(texts)


def test_chance_of_a_miss():
    assert (1 - near_copies.SIMILARITY**near_copies.ROWS) ** near_copies.BANDS < 1e-4


def test_all_pairs_within_cells(spark, monkeypatch):
    """Copies of one text that are each too far from most others: blocks of a cell, of one and of many."""
    from vodlens.llm.components import components

    r = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    texts = {}
    for k in range(120):
        copy = list(base)
        for _ in range(r.randrange(3)):
            copy[r.randrange(80)] = f"x{r.randrange(999)}"
        texts[k] = " ".join(copy)
    sets = {k: shingles(t) for k, t in texts.items()}
    rows = spark.createDataFrame([(k % 2, k, len(sets[k]), t) for k, t in texts.items()], "cell long, node long, n int, text string")
    for block_sets in (1_024, 17):
        found = near_copies._within_cells(rows.select("cell", "node", "n"), rows.select("node", "text"), 5, 0.8, block_sets, 10**9)
        roots = {x.node: x.root for x in components(found).collect()}
        for cell in (0, 1):
            mine = {k: texts[k] for k in texts if k % 2 == cell}
            assert {roots.get(k, k) for k in mine} == expected(mine)


def test_shared_counts():
    r = random.Random(6)
    sets = [near_copies.np.unique(near_copies.np.array([r.randrange(60) for _ in range(r.randrange(1, 40))], near_copies.np.uint64)) for _ in range(30)]
    got = near_copies.shared_counts(sets, width=7)
    assert all(got[i][j] == len({*a.tolist()} & {*b.tolist()}) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
