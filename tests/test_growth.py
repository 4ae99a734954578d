"""Work that may grow no faster than its input: what is held, handed over, joined and written."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from vodlens.operators import blocks, chat as chat_ops, folds, knowledge, media, search, temporal
from vodlens.streaming import broadcast


def test_a_fold_that_does_not_forget_visits_a_block_a_few_times(spark, monkeypatch):
    visits = []
    handed = blocks._handed
    monkeypatch.setattr(blocks, "_handed", lambda rows, fold, keys, old, new: visits.extend(new) or handed(rows, fold, keys, old, new))
    rows = spark.range(300).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.col("id").alias("i"))
    out = folds.thinned(rows, ["k"], "t", "i", 7.0, rows_per_block=25).collect()  # every block's own fold is out of step
    assert sorted(r.i for r in out) == list(range(0, 300, 7))
    assert max(map(visits.count, visits)) <= 3


def test_leaders_hold_no_row_of_a_cluster_and_no_empty_one():
    fold = folds.Leaders(0.6, 10.0, 2)
    fold.reset()
    for k in range(10):
        fold.step(k / 100, k, f"u{k}", ["a", "b"])
        fold.step(k / 100, 100 + k, f"u{k}", [])
    assert len(fold.get()) == 10
    out = fold.step(10.5, 50, "u1", ["c"])
    assert [v for _, _, v in out] == [(0, 0.0, 0.09, 10, 10)] and [h[1] for h in fold.get()] == [50]


def test_a_failing_seed_compares_its_token_set_once(monkeypatch):
    made = []

    class Counted(folds.Group):
        def __init__(self, tokens):
            made.append(tokens)
            super().__init__(tokens)

    monkeypatch.setattr(folds, "Group", Counted)
    fold = folds.Leaders(0.6, 10.0, 2)
    fold.reset()
    out = [x for k in range(3_000) for x in fold.step(k / 1000, k, "spammer", ["a", "b"])] + fold.close()
    assert not out and len(made) == 1


class Kept:
    """Just enough of a state handle."""

    def __init__(self):
        self.rows, self.timers = {}, []
        self.getMapState = self.getListState = lambda *a: self
        self.iterator, self.get, self.listTimers = lambda: iter(()), lambda: iter(()), lambda: iter(())
        self.updateValue = self.put = self.registerTimer = self.clear = lambda *a: None


def test_a_broadcast_gives_its_rows_out_in_bounded_frames():
    ops = [("join", f"c{k}", ["*"] if k % 2 else ["view"], None, None) for k in range(300)] + [("event", None, None, "view" if k % 4 else "purchase", k) for k in range(400)]
    rows = pd.DataFrame([(pd.Timestamp(k, unit="s"), k, *op, 0) for k, op in enumerate(ops)], columns=["at", "seq", "op", "client", "topics", "event_type", "item", "count"])
    b = broadcast.Broadcaster(40, 0, 10**12)
    b.init(Kept())
    frames = list(b.handleInputRows(("1", 0), iter([rows]), None))
    got = pd.concat(frames)
    assert max(map(len, frames)) <= 50_000 and len(frames) > 1
    assert got["what"].value_counts().to_dict() == {"JOINED": 300, "QUEUED": 300 * 40, "DROPPED": 300 * 300 + 150 * 100 - 300 * 40}
    assert got[got["client"] == "c0"]["item"].dropna().tolist() == [k for k in range(400) if k % 4]


def test_a_change_of_topics_looks_at_no_other_client(monkeypatch):
    asked = []
    fits = broadcast.fits
    monkeypatch.setattr(broadcast, "fits", lambda topics, kind: asked.append(1) or fits(topics, kind))
    ops = [("join", f"c{k}", ["view"], None, None) for k in range(200)]
    for k in range(300):
        ops += [("join", f"c{k % 200}", ["view"] if k % 3 else ["purchase"], None, None), ("event", None, None, "purchase" if k % 2 else "view", k)]
    rows = pd.DataFrame([(pd.Timestamp(k, unit="s"), k, *op, 0) for k, op in enumerate(ops)], columns=["at", "seq", "op", "client", "topics", "event_type", "item", "count"])
    b = broadcast.Broadcaster(40, 5, 10**12)
    b.init(Kept())
    got = pd.concat(list(b.handleInputRows(("1", 0), iter([rows]), None)))
    topics, queued, want = {}, {}, []
    for op, client, wanted, kind, item in ops:
        if op == "join":
            topics[client] = wanted
        else:
            for c in (c for c, w in topics.items() if kind in w):
                queued[c] = queued.get(c, 0) + 1
                want.append((c, item, "QUEUED" if queued[c] <= 40 else "DROPPED"))
    rest = got[got["what"] != "JOINED"]
    assert sorted(zip(rest["client"], rest["item"], rest["what"])) == sorted(want) and len(asked) <= 2 * 200 + 2 * 300


def most_rows(df):
    """The rows that the plan's largest step gave out when it ran, with the result."""
    found, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.finalPhysicalPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return found, most


def test_nearest_makes_no_pairs(spark):
    left = spark.range(600).select(F.lit(1).alias("k"), F.col("id").alias("l"), (F.col("id") * 0.01).alias("t"))
    right = spark.range(600).select(F.lit(1).alias("k"), F.col("id").alias("r"), (F.floor(F.col("id") / 2) * 0.02 + 0.005).alias("t"))
    found, most = most_rows(temporal.nearest(left, right, ["k"], "t", "t", 8.0, "r"))
    pairs = [(k * 2, k // 1 * 0.02 + 0.005) for k in range(300)]
    want = {x: min((round(abs(t - x * 0.01), 9), t, r) for r, t in pairs)[2] for x in range(0, 600, 2)}
    assert {r.l: r.n_id for r in found if r.l % 2 == 0} == want and len(found) == 600 and most < 5_000


def test_no_frame_ends_with_its_partition(spark):
    """Such a frame is worked out anew for each row, which is quadratic in a block's rows."""
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (1, 3, 3.0), (2, 4, 9.0), (1, 5, None)], "k int, i long, t double")
    left, right = rows.select("k", F.col("i").alias("l"), "t"), rows.where("i > 1")
    for found in (temporal.nearest(left, rows, ["k"], "t", "t", 8.0, "i"), temporal.asof_forward(left, right, ["k"], "t", "t", 5.0, "i", ["i"]), temporal.asof_forward(left, right, ["k"], "t", "t", 5.0, "i", ["i"], block=2.0)):
        assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert {(r.l, r.r_i) for r in found.collect()} == {(1, 2), (2, 2), (3, 2), (4, 4), (5, None)}


def test_slang_context_counts_windows_without_pairs(spark):
    spans = spark.range(400).select(F.lit(1).alias("s"), F.lit("kekw").alias("term"), (F.col("id") * 0.5).alias("window_start"), (F.col("id") * 0.5 + 98).alias("window_end"))
    chat = spark.range(400).select(F.lit(1).alias("s"), (F.col("id") * 0.5).alias("timestamp_offset"), F.lit("KEKW based based").alias("content"))
    found, most = most_rows(media.slang_context(spans, chat, ["s"], 100.0))
    pairs = sum(1 for w in range(400) for m in range(400) if w * 0.5 <= m * 0.5 <= w * 0.5 + 100)
    assert pairs > 50_000 and most < 5_000 and {r.votes for r in found} == {2 * pairs}


def test_context_makes_no_pairs(spark):
    chunks = spark.range(300).select(F.lit(1).alias("s"), F.col("id").alias("c"), F.col("id").cast("double").alias("t"))
    chat = spark.range(900).select(F.lit(1).alias("s"), F.col("id").alias("message_id"), (F.col("id") / 3).alias("timestamp_offset"), F.lit("x").alias("content"))
    found, most = most_rows(search.chat_context(chunks, chat, ["s"], "c", "t", 60.0, 4))
    want = {(c, r + 1, max(0, 3 * (c - 60)) + r) for c in range(300) for r in range(4)}
    assert {(r.c, r.r, r.message_id) for r in found} == want and most < 5_000


def test_responses_make_no_pairs(spark):
    texts = ["based take here", "take that", "no echo at all", "based"]
    talk = [(1, k, f"u{k % 3}", k * 0.5, texts[k % 4]) for k in range(800)] + [(1, 3, "u0", 1.5, "based"), (2, 900, "u1", 10.0, texts[0])]
    chat = spark.createDataFrame(talk, "stream_id long, message_id long, author_name string, timestamp_offset double, content string")
    said = [(1, k * 0.5 + 40 * (k // 100), k * 0.5 + 40 * (k // 100) + 30.0, "STREAMER", "a based take" if k % 2 else "this take") for k in range(400)] + [(1, 0.0, 900.0, "GUEST", texts[0])]
    speech = spark.createDataFrame(said, "stream_id long, start_sec double, end_sec double, speaker_label string, transcript string")
    words = {c: {w for w in c.split() if len(w) > 1} for c in [*texts, "a based take", "this take"]}
    want, pairs = set(), 0
    for s, i, a, t, c in talk:
        hits = [1 for p, b, e, who, x in said if p == s and who == "STREAMER" and len(words[c]) >= 2 and b - 5 <= t + 3 <= e and (len(words[c] & words[x]) >= 2 or len(words[c]) == 2 and words[c] & words[x])]
        pairs += len(hits)
        want |= {(s, i, a)} if hits else set()
    found, most = most_rows(chat_ops.responses(chat, speech, ["stream_id"]))
    assert sorted(map(tuple, found)) == sorted(want) and pairs > 10_000 and most < 5_000


def test_leaders_split_a_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        calls.add(1)
        return text.split()

    rows = spark.range(400).select(F.lit(1).alias("s"), F.col("id").cast("double").alias("t"), F.col("id").alias("i"), (F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") % 2 == 0, "a b").otherwise("c d").alias("c"))
    leaders = lambda d, c, **k: sorted(map(tuple, folds.leader_clusters(d, ["s"], "t", "i", "a", c, 0.6, 10.0, 3, rows_per_block=100, **k).collect()))
    found = leaders(rows, "c", split=split)
    assert calls.value == 400 and len(found) > 50
    assert found == leaders(rows.withColumn("w", F.split("c", " ")), "w")


def test_values_are_those_of_pyarrow():
    for c in (pa.array([1, 2]), pa.array([1.5, float("inf")]), pa.array([1, None]), pa.array(["a", "b", "a"]), pa.array(["a", None]), pa.array([["a"], None]), pa.array([True]), pa.array([], pa.string())):
        assert blocks.values(c) == c.to_pylist() and list(map(type, blocks.values(c))) == list(map(type, c.to_pylist()))


def test_documents_share_files(spark, data, tmp_path, monkeypatch):
    from vodlens.plans import feeds

    monkeypatch.setattr(feeds, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    for query, name in ((feeds.replay_files, "replays"), (feeds.manifest_fields, "manifests")):
        assert query(spark, data).count() > 0
        assert len(list((tmp_path / name).rglob("part-*"))) <= 8


def test_entity_counts_take_equal_texts_once(spark):
    rows = spark.createDataFrame([("playing lol", "chat", 5), ("lol and lol", "src0", 2), ("none", "chat", 9)], "text string, source string, n long")
    out = knowledge.entity_counts(rows, "text", "source", {"src0": 2}, "n").collect()
    assert [(r.entity, r.weighted, r.n_texts) for r in out] == [("League of Legends", 9.0, 7)]
