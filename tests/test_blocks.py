"""Folds over blocks: one long key in many tasks gives the rows of one task."""

import random

import pytest
from pyspark.sql import functions as F

from vodlens.operators import blocks, folds

N = 3_000


@pytest.fixture(scope="module")
def stream(spark):
    """One long recording, a few short ones and one of a single row."""
    r = random.Random(1)
    rows, t = [], 0.0
    words = ["kekw", "lul", "pog", "wow", "cap", "based"]
    for k in range(N):
        t += r.choice([0.0, 0.2, 0.5, 1.0, 3.0])
        rows.append((7, k, t, t + r.random() * 4, r.choice(words), f"u{r.randrange(9)}", [r.choice(words) for _ in range(r.randrange(4))] if k % 11 else None, r.choice(["A", "A", "A", "B", "UNKNOWN"]), r.randrange(1, 30), r.randrange(1, 9)))
    rows += [(k, 10_000 + k * 10 + j, float(j), j + 1.0, "x", "u", ["x"], "A", 9, 5) for k in (1, 2, 3, 9, 11) for j in range(k)]
    return spark.createDataFrame(rows, "s long, i long, t double, e double, w string, a string, tokens array<string>, scene string, n long, people long").repartition(5)


CASES = {
    "thinned": lambda d, n: folds.thinned(d, ["s"], "t", "i", 2.5, rows_per_block=n),
    "scenes": lambda d, n: folds.scene_segments(d, ["s"], "t", "scene", "i", 4.0, rows_per_block=n),
    "chunks": lambda d, n: folds.chunked(d, ["s"], "t", "e", "w", rows_per_block=n),
    "captions": lambda d, n: folds.caption_lines(d, ["s"], "t", "e", "w", 4, 0.8, rows_per_block=n),
    "leaders": lambda d, n: folds.leader_clusters(d, ["s"], "t", "i", "a", "tokens", 0.6, 10.0, 3, rows_per_block=n),
    "bursts": lambda d, n: folds.ema_bursts(d, ["s"], "i", "n", "people", 10.0, 4, 3, 2.0, rows_per_block=n),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks_do_not_matter(spark, stream, name):
    whole = sorted(map(tuple, CASES[name](stream, 10**9).collect()))
    assert whole
    for n in (400, 97):
        assert sorted(map(tuple, CASES[name](stream, n).collect())) == whole, n


def leaders(rows, similar, within, authors):
    """All later rows of each seed, one after another."""
    used, out = set(), []
    for k, (t, i, a, seed) in enumerate(rows):
        if k in used or not seed:
            continue
        member = [k]
        for j in range(k + 1, len(rows)):
            if rows[j][0] - t > within:
                break
            if j not in used and rows[j][3] and len(seed & rows[j][3]) / len(seed | rows[j][3]) >= similar:
                member.append(j)
        if len({rows[j][2] for j in member}) >= authors:
            used |= set(member)
            out.append((7, i, t, max(rows[j][0] for j in member), len({rows[j][2] for j in member}), len(member)))
    return out


def test_leaders_equal_a_plain_loop(spark, stream):
    rows = [(r.t, r.i, r.a, frozenset(r.tokens or ())) for r in stream.where("s = 7").orderBy("t", "i").collect()]
    got = [tuple(r) for r in CASES["leaders"](stream, 150).where("s = 7").orderBy("seed").collect()]
    assert got == sorted(leaders(rows, 0.6, 10.0, 3), key=lambda r: r[1])


def test_forgetful_folds_settle_at_once(spark, stream):
    for fold, take in ((folds.Captions(4, 0.8), ["t", "e", "w"]), (folds.Leaders(0.6, 10.0, 3), ["t", "i", "a", "tokens"]), (folds.Scenes(4.0), ["i", "t", "scene"])):
        held = blocks.in_blocks(stream.where("s = 7"), ["s"], ["t", "i"], 200).select("block", "s", *take)
        assert held.rdd.getNumPartitions() == 15 and held.groupBy("block").count().count() >= 12
        _, _, closing, rounds = blocks.settled(held, fold, 1)
        assert rounds <= 2 and len(closing) == 1


def total_fold():
    """A fold that forgets nothing; made here, so that it travels with the task."""

    class Total(blocks.Fold):
        number_at = 1

        def reset(self):
            self.sum = 0

        def get(self):
            return self.sum

        def set(self, state):
            self.sum = state

        def step(self, x):
            self.sum += x
            return [(1, 0, (self.sum,))]

        def close(self):
            return [(0, 0, (-self.sum,))]

    return Total()


def test_a_fold_that_remembers_everything(spark, stream):
    got = blocks.folded(stream, ["s"], ["i"], ["n"], total_fold(), "s long, total long, place long", 300)
    want = []
    for s in (1, 2, 3, 7, 9, 11):
        total, place = 0, 0
        for r in stream.where(F.col("s") == s).orderBy("i").collect():
            total, place = total + r.n, place + 1
            want.append((s, total, place))
        want.append((s, -total, place))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty(spark, stream):
    for case in CASES.values():
        assert case(stream.limit(0), 100).collect() == []
