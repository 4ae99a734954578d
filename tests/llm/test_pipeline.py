"""The pipeline against a plain version of each stage, on the smallest documents."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from test_near_copies import expected
from vodlens.llm import quality

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Each stage's rows, by doc_id."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def test_quality_keeps_what_scores_enough(spark, data, stages):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    rows = docs.collect()
    kept = {r.doc_id for r, s in zip(rows, model.scores([r.text or "" for r in rows])) if s >= quality.THRESHOLD}
    assert set(stages[0]) == kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    good = [i for i in labels if labels[i] == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def test_lines(stages):
    counts = Counter(k for r in stages[0].values() for k in {key(x) for x in (r.text or "").split("\n")} if k)
    want = {i: "\n".join(x for x in (r.text or "").split("\n") if counts[key(x)] < 10 or not key(x)) for i, r in stages[0].items()}
    assert {i: r.text for i, r in stages[1].items()} == want


def test_copies(stages):
    assert set(stages[2]) == expected({i: r.text for i, r in stages[1].items()})


def test_leaks(spark, data, stages):
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    flat = {i: " ".join((r.text or "").lower().split()) for i, r in stages[2].items()}
    assert set(stages[3]) == {i for i, t in flat.items() if not any(b in t for b in bench)}


def test_tokens(stages):
    from tokenizers import Tokenizer

    from vodlens.llm.bpe import default_vocabulary

    t = Tokenizer.from_file(default_vocabulary())
    assert set(stages[4]) == set(stages[3])
    for i, r in stages[3].items():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert stages[4][i].n_tokens == len(ids) and stages[4][i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_run_gives_the_last_stage(spark, data, stages):
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, data).collect()} == {i: r.ids_sha256 for i, r in stages[4].items()}
