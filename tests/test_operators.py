"""Small cases with hand-made results, and edge cases of the general operators."""

import math

import pytest
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.operators import chat, clips, costream, folds, fusion, islands, knowledge, search, sponsor, store, temporal

CHAT = "stream_id int, message_id string, timestamp_offset double, user_id string, author_name string, content string"
SPEECH = "stream_id int, segment_id int, start_sec double, end_sec double, speaker_label string, transcript string"
FRAMES = "stream_id int, frame_index int, timestamp_sec double, scene_type string, screen_summary string, ocr_text_blocks array<string>"


def says(spark, *rows):
    return spark.createDataFrame([(1, f"m{k}", float(t), f"id_{a}", a, text) for k, (t, a, text) in enumerate(rows)], CHAT)


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_latency_shift_puts_message_in_bucket_five(spark):
    c = says(spark, (14.0, "a", "OMEGALUL TRUE"), (1.0, "b", "early"))
    b = spark.createDataFrame([(1, 20.0)], "stream_id int, duration double")
    rows = {r.bucket_index: r.message_count for r in temporal.tumbling_counts(c, b, ["stream_id"], "timestamp_offset", 2.0, 4.0).collect()}
    assert len(rows) == 11 and rows[5] == 1 and rows[0] == 1 and sum(rows.values()) == 2
    assert {r.token for r in chat.top_tokens(c, ["stream_id"], width=2.0, lag=4.0).where("bucket_index = 5").collect()} == {"OMEGALUL", "TRUE"}


def test_fusion_slice(spark):
    c = says(spark, (11.0, "a", "TRUE TRUE based"))
    s = spark.createDataFrame([(1, 0, 10.0, 14.0, "STREAMER", "hello there")], SPEECH)
    k = spark.createDataFrame([(1, 0, 10.0, "GAMEPLAY", "a game", [])], FRAMES)
    b = spark.createDataFrame([(1, 20.0)], "stream_id int, duration double")
    m = {r.bucket_index: r for r in fusion.build_matrix(c, s, k, b, ["stream_id"], 2.0, 0.0).collect()}
    assert len(m) == 11
    assert m[5].streamer_transcript == "hello there" and m[5].active_scene_type == "GAMEPLAY" and m[5].chat_message_count == 1 and m[5].agreement_score == 1.0
    assert m[6].streamer_transcript == "hello there" and m[7].streamer_transcript is None
    assert m[4].active_scene_type == "UNKNOWN" and m[10].active_scene_type == "GAMEPLAY"


def test_highlight_labels(spark):
    rows = spark.createDataFrame([(0.0, 2.0, True, -0.75), (4.0, 6.0, True, 0.10), (8.0, 10.0, True, None), (12.0, 14.0, False, 1.0)], "start_sec double, end_sec double, is_spike_moment boolean, agreement_score double")
    assert [r.alignment_label for r in fusion.highlights(rows).orderBy("start_sec").collect()] == ["AUDIENCE_REVOLT", "DIVIDED", "NEUTRAL"]


@pytest.mark.parametrize("text, intent", [("LULW KEKW", "AMUSEMENT"), ("POGGERS clutch", "HYPE"), ("noshot cap", "DISBELIEF"), ("weirdchamp yikes", "DISGUST_CRINGE"), ("based facts", "AGREEMENT"), ("love <3", "HEART_WARM"), ("why though?", "QUESTION"), ("hello", "NEUTRAL"), ("", "NEUTRAL")])
def test_intents(spark, text, intent):
    assert chat.intents(says(spark, (0, "a", text)), ["message_id"]).first().primary_intent == intent


def test_bots_and_verdicts(spark):
    c = says(spark, (0, "Nightbot", "hi"), (1, "u", "!uptime"), (2, "u", "hello"), (3, "u", None))
    assert [r[0] for r in c.select(chat.is_bot(F.col("author_name"), F.col("content"))).collect()] == [True, True, False, False]
    verdict = lambda text, **flags: one(spark, text).select(chat.safety_verdict(F.col("v"), **{k: F.lit(x) for k, x in flags.items()})["verdict"]).first()[0]
    assert verdict("you are trash lul", failure=True) == "GOOD_NATURED_BANTER"
    assert verdict("so bald and greasy") == "COMMUNITY_ROAST"
    assert verdict("loser stfu", serious=True) == "BAD_FAITH_GRIEFING"
    assert verdict("i will doxx you") == "MALICIOUS_HARASSMENT"


def test_profiles(spark):
    c = says(spark, *[(k, "friendly", "lmao you are bad") for k in range(5)], *[(k, "hostile", "loser stfu die") for k in range(5)])
    got = {r.user_id: r for r in chat.profiles(c).collect()}
    assert got["id_friendly"].flagged_status == "CLEAN" and got["id_friendly"].banter_reciprocity > 0.8
    assert got["id_hostile"].griefer_score > 0.5 and got["id_hostile"].flagged_status in ("WATCHLIST", "SAFETY_ALERT")


def test_meme_burst_and_influence(spark):
    rows = [(100 + 1.2 * k, f"chatter_{k}", "chat is this real copium" if k % 2 else "chat is this real copium !") for k in range(6)] + [(103.0, "x", "unrelated words here")]
    c = says(spark, *rows).withColumn("tokens", C.similarity_tokens(F.col("content")))
    burst = folds.leader_clusters(c, ["stream_id"], "timestamp_offset", "message_id", "author_name", "tokens", 0.6, 10.0, 5).collect()
    assert len(burst) == 1 and burst[0].n_authors == 6 and (burst[0].start_sec, burst[0].end_sec) == (100.0, 106.0) and burst[0].seed == "m0"
    talk = says(spark, *[(10 + k, n, "copium is real today") for k, n in enumerate(["leader", "b", "c", "d"])])
    speech = spark.createDataFrame([(1, 0, 14.5, 17.0, "STREAMER", "copium is real they say")], SPEECH)
    origins = spark.createDataFrame([("leader",)], "author_name string")
    ranked = chat.influence(talk, origins, chat.responses(talk, speech, ["stream_id"])).orderBy(F.desc("influence_score")).collect()
    assert ranked[0].author_name == "leader" and ranked[0].responses == 1 and ranked[0].influence_score > 0.8


def test_response_windows_find_long_segments(spark):
    talk = says(spark, (100.0, "a", "alpha beta"), (500.0, "b", "alpha beta"))
    speech = spark.createDataFrame([(1, 0, 10.0, 400.0, "STREAMER", "alpha beta")], SPEECH)
    assert [r.author_name for r in chat.responses(talk, speech, ["stream_id"]).collect()] == ["a"]


def test_asof_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([(1, 10000), (1, 60000), (2, 5)], "k int, ts long")
    right = spark.createDataFrame([(1, 12500, "first", 1), (1, 15000, "second", 2), (1, 10000, "exact", 3)], "k int, ts long, text string, id int")
    got = {r.ts: r for r in temporal.asof_forward(left, right.where("text <> 'exact'"), ["k"], "ts", "ts", 8000, "id", ["text"]).collect()}
    assert got[10000].r_text == "first" and got[60000].r_text is None and got[5].r_ts is None
    assert {r.r_text for r in temporal.asof_forward(left, right, ["k"], "ts", "ts", 8000, "id", ["text"]).where("ts = 10000").collect()} == {"exact"}


def test_joins_on_empty_tables(spark):
    left = spark.createDataFrame([], "k int, ts double, id int")
    assert temporal.range_join(left, left.select("k", F.col("ts").alias("a"), F.col("ts").alias("b")), ["k"], "ts", "a", "b", 5.0).count() == 0
    assert temporal.nearest(left, left, ["k"], "ts", "ts", 5.0, "id").count() == 0
    assert islands.gap_islands(left, ["k"], "ts", "ts", ["ts"], 1.0).count() == 0
    assert folds.thinned(left, ["k"], "ts", "id", 1.0).count() == 0


def test_overlap_is_strict(spark):
    rows = spark.createDataFrame([(1, 2.0, 4.0), (2, 3.0, 3.0), (3, 3.9, 4.1)], "i int, s double, e double")
    got = temporal.overlap_buckets(rows, "s", "e", 2.0).select("i", "bucket_index").collect()
    assert sorted((r.i, r.bucket_index) for r in got) == [(1, 1), (3, 1), (3, 2)]


def test_nearest_prefers_earlier_on_ties(spark):
    a = spark.createDataFrame([(1, 10.0)], "k int, ts double")
    b = spark.createDataFrame([(1, 12.0, 1), (1, 8.0, 2), (1, 30.0, 3)], "k int, ts double, id int")
    assert temporal.nearest(a, b.withColumnRenamed("ts", "b_ts"), ["k"], "ts", "b_ts", 8.0, "id").first().n_ts == 8.0


def test_islands_and_merges(spark):
    rows = spark.createDataFrame([(1, 10.0, 15.0), (1, 20.0, 20.0), (1, 25.0, 30.0), (1, 200.0, 205.0)], "k int, s double, e double")
    got = islands.gap_islands(rows, ["k"], "s", "e", ["s"], 30.0).orderBy("start_sec").collect()
    assert [(r.start_sec, r.end_sec) for r in got] == [(10.0, 30.0), (200.0, 205.0)]
    rows = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 3.0), (1, 5.0, 6.0), (1, 10.0, 11.0), (1, 12.0, 13.0)], "k int, s double, e double")
    assert [(r.start_sec, r.end_sec) for r in islands.merge_intervals(rows, ["k"], "s", "e", ["s", "e"]).orderBy("start_sec").collect()] == [(0.0, 11.0), (12.0, 13.0)]


def test_stance_shift(spark):
    rows = spark.createDataFrame([("e", 1, 1.0), ("e", 2, -1.0)], "e string, i int, v double")
    shift = islands.shifts(rows, ["e"], "v", ["i"]).collect()
    assert len(shift) == 1 and shift[0].delta == -2.0 and shift[0].is_reversal
    assert islands.volatility(rows, ["e"], "v", ["i"]).first().volatility == 1.0


def test_debate(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 5.0, "A", ""), (1, 1, 4.2, 8.0, "B", ""), (1, 2, 8.2, 12.0, "A", "")], SPEECH)
    t = islands.turns(rows, ["stream_id"], "speaker_label", "start_sec", "end_sec", ["start_sec"])
    assert [r.interrupts_previous for r in t.orderBy("start_sec").collect()] == [False, True, False]
    share = {r.speaker_label: r.talk_sec for r in islands.talk_share(t, ["stream_id"], "speaker_label", "start_sec", "end_sec").collect()}
    assert math.isclose(share["A"], 7.8) and math.isclose(share["B"], 3.8)


def test_scene_segments(spark):
    rows = [(1, k, 2.0 * k, "FULLSCREEN_CAM" if k < 40 else "REACT_VIDEO") for k in range(90)]
    seg = folds.scene_segments(spark.createDataFrame(rows, "s int, i int, t double, scene string"), ["s"], "t", "scene", "i", 60.0)
    starts = seg.groupBy("segment_id").agg(F.min("t").alias("t")).orderBy("segment_id").collect()
    assert [r.t for r in starts] == [0.0, 80.0]
    assert one(spark, 80.0, "double").select(C.clock(F.col("v"))).first()[0] == "01:20"


def test_nms_thinning_chunks_captions(spark):
    rows = spark.createDataFrame([(1, k, float(t), s) for k, (t, s) in enumerate([(0, 0.5), (10, 0.9), (50, 0.8), (56, 0.7), (120, 0.6)])], "s int, i int, t double, score double")
    assert [r.i for r in folds.greedy_nms(rows, ["s"], "t", "score", "i", 45.0).orderBy("pick").collect()] == [1, 3, 4]
    assert [r.i for r in folds.greedy_nms(rows, ["s"], "t", "score", "i", 45.0, 2).orderBy("pick").collect()] == [1, 3]
    assert [r.i for r in folds.thinned(rows, ["s"], "t", "i", 50.0).orderBy("t").collect()] == [0, 2, 4]
    speech = spark.createDataFrame([(1, 0, 0.0, 6.0, "S", "a"), (1, 1, 6.0, 14.0, "S", "b"), (1, 2, 14.0, 20.0, "S", "c"), (1, 3, 20.0, 21.0, "S", " ")], SPEECH)
    got = folds.chunked(speech, ["stream_id"], "start_sec", "end_sec", "transcript").orderBy("chunk_no").collect()
    assert [(r.start_sec, r.end_sec, r.text) for r in got] == [(0.0, 14.0, "a b"), (11.0, 20.0, "c")]
    words = spark.createDataFrame([(1, 0.1 * k, 0.1 * k + 0.05, f"w{k}") for k in range(7)] + [(1, 5.0, 5.1, "late")], "s int, a double, b double, w string")
    assert [r.text for r in folds.caption_lines(words, ["s"], "a", "b", "w").orderBy("line_no").collect()] == ["w0 w1 w2 w3 w4", "w5 w6", "late"]


def test_lag_and_offsets(spark):
    bins = [(1, k, 1.0 if 5 <= k <= 9 else 0.0, 1.0 if 9 <= k <= 13 else 0.0) for k in range(40)]
    got = costream.correlation_offset(spark.createDataFrame(bins, "k int, bin int, a double, b double"), ["k"], 20, 0.5).first()
    assert got.offset_sec == 2.0 and got.confidence > 0.85
    a = spark.createDataFrame([(1, k, t) for k, t in enumerate((10.0, 25.0, 50.0))], "k int, i int, t double")
    b = spark.createDataFrame([(1, k, t) for k, t in enumerate((13.2, 28.2, 53.2))], "k int, i int, t double")
    assert math.isclose(costream.trigger_offset(a, b, ["k"], "t", "i").first().offset_sec, 3.2)


def test_unified_order(spark):
    rows = spark.createDataFrame([("A", 4.0), ("B", 15.0), ("A", 12.0), ("C", 5.0), ("B", 25.0)], "channel_id string, t double")
    offsets = spark.createDataFrame([("A", 0.0), ("B", 10.0)], "channel_id string, offset_sec double")
    assert sorted(r.unified_ts for r in costream.unified(rows, offsets, "t").collect()) == [4.0, 5.0, 5.0, 12.0, 15.0]


def test_bm25_and_deletes(spark):
    docs = spark.createDataFrame([("doc1", "World of Warcraft by Blizzard, WoW raids"), ("doc2", "Deadlock recoil is strange"), ("doc3", "cooking show")], "id string, text string")
    hits = {r.id for r in search.bm25(docs, "id", "text", ["deadlock", "recoil"]).collect()}
    assert hits == {"doc2"}
    left = store.delete(docs, docs.where("id = 'doc2'"), ["id"])
    assert search.bm25(left, "id", "text", ["deadlock"]).count() == 0 and left.count() == 2


def test_embeddings(spark):
    docs = spark.createDataFrame([(0, "the boss fight was hard"), (1, "the boss fight was really hard"), (2, "cooking pasta recipe"), (3, "")], "id int, text string")
    e = {r.id: r.embedding for r in search.embedded(docs, "id", "text").collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(e[a], e[b]))
    assert math.isclose(dot(0, 0), 1.0) and dot(0, 1) > dot(0, 2) and dot(3, 3) == 0 and len(e[3]) == 128


def test_sponsor_cluster(spark):
    s = spark.createDataFrame([(1, k, a, b, "STREAMER", "this is sponsored by nord vpn") for k, (a, b) in enumerate([(10.0, 15.0), (25.0, 30.0), (200.0, 205.0)])], SPEECH)
    k = spark.createDataFrame([(1, 0, 20.0, "X", "", ["NordVPN deal", "nordvpn.com"])], FRAMES)
    brands = [{"brand_id": "nord", "brand_name": "NordVPN"}]
    got = sponsor.segments(sponsor.mentions(s, k, ["stream_id"], brands), ["stream_id"]).orderBy("start_sec").collect()
    assert [(r.start_sec, r.end_sec, r.n_audio, r.n_ocr) for r in got] == [(10.0, 30.0, 2, 2), (200.0, 205.0, 1, 0)]


@pytest.mark.parametrize("pattern, text, hit", [("Raid", "raids are fun", True), ("Raid", "rxid shadow", True), ("Raid", "rxxd", False), ("ab", "xaxb", False), ("NordVPN", "nord vpn", True), ("", "x", False)])
def test_fuzzy(spark, pattern, text, hit):
    assert one(spark, text).select(C.fuzzy_match(pattern, F.col("v"))).first()[0] is hit


def test_claims_and_leaks(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 1.0, "S", "Elden Ring combat was amazing"), (1, 1, 1.0, 2.0, "S", "nothing here"), (1, 2, 2.0, 3.0, "S", "it was bad")], SPEECH)
    got = {r.segment_id: r for r in knowledge.claims(s, ["segment_id"]).collect()}
    assert set(got) == {0, 2} and got[0].subject_entity == "Elden Ring" and got[0].predicate == "has_gameplay" and got[2].subject_entity == "Stream Topic"
    t = spark.createDataFrame([(1, "card 4111 1111 1111 1112 mail a@b.com"), (2, "0000-0000-0000-0000 127.0.0.1"), (3, None), (4, "8.8.8.8 token=abcdefghijklmnopq")], "id int, text string")
    assert sorted((r.id, r.kind) for r in knowledge.leaks(t, ["id"], "text").collect()) == [(1, "card"), (1, "email"), (4, "ip"), (4, "token")]


def test_upserts_and_lexicon(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.upsert(t, b, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    kind = "term string, confidence double, valence double, occurrences long, peak_z double, last_seen timestamp"
    state, batch = spark.createDataFrame([("x", 0.5, 1.0, 3, 2.0, None)], kind), spark.createDataFrame([("x", 1.0, 0.0, 2, 3.0, None), ("y", 0.4, 0.1, 1, 1.0, None)], kind)
    got = {r.term: r for r in knowledge.upsert_lexicon(state, batch).collect()}
    assert math.isclose(got["x"].confidence, 0.8) and math.isclose(got["x"].valence, 0.3) and got["x"].occurrences == 5 and got["x"].peak_z == 3.0 and got["y"].occurrences == 1


def test_run_comparison_and_validation(spark):
    a = spark.createDataFrame([("s1", 1.5), ("s2", 1.3), ("s3", 1.0), ("new", 1.0)], "k string, v double")
    b = spark.createDataFrame([("s1", 1.0), ("s2", 1.0), ("s3", 1.0)], "k string, v double")
    assert {r.k: r.level for r in store.compare_runs(a, b, "k", "v").collect()} == {"s1": "CRITICAL", "s2": "WARNING", "s3": "OK", "new": "NEW"}
    j = spark.createDataFrame([('{"k": 1}',), ("{broken",), ('{"other": 2}',), (None,)], "j string")
    assert [r.is_valid for r in store.validated(j, "j", "k bigint", ["k"]).collect()] == [True, False, False, False]


def test_clip_scores_and_facecam(spark):
    a = clips.arc(F.lit(0.5), F.lit(4.0))
    assert one(spark, 1, "int").select(a["narrative_arc"]).first()[0] == "INSTANT_CLIMAX_REACTION"
    v = clips.virality(F.lit("h"), F.lit("HYPE"), F.lit(2.0), F.lit(25.0), F.lit(1), F.lit("PASSED"))
    assert math.isclose(one(spark, 1, "int").select(v).first()[0], 0.35 * 95 + 0.25 * 70 + 0.2 * 95 + 0.2 * 62)
    boxes = [("face", 0.9, [0.4, 0.4, 0.6, 0.6]), ("person", 0.9, [0.0, 0.0, 0.2, 0.2]), ("person", 0.9, [0.0, 0.0, 1.0, 1.0]), ("dog", 0.9, [0.9, 0.9, 1.0, 1.0])]
    df = spark.createDataFrame([(boxes,), ([],)], "o array<struct<label:string,confidence:double,box:array<double>>>")
    got = [r[0] for r in df.select(clips.facecam(F.col("o"))).collect()]
    assert got[0].box == [0.0, 0.0, 0.2, 0.2] and got[1] is None


def test_text_functions(spark):
    df = one(spark, "Yesss!! café-Bar 2")
    assert df.select(C.collapse_runs(F.col("v"))).first()[0] == "yes!! café-bar 2"
    assert df.select(C.similarity_tokens(F.col("v"))).first()[0] == ["yesss", "café", "bar"]
    assert df.select(C.subtitle_clock(F.lit(3725.5))).first()[0] == "1:02:05.50"
    assert df.select(C.epoch_seconds(F.lit(1.7e15)), C.epoch_seconds(F.lit(1.7e12)), C.epoch_seconds(F.lit(1.7e9))).first()[:] == (1.7e9, 1.7e9, 1.7e9)


def test_overlap_join_meets_in_points_and_once(spark):
    import itertools

    left = [(1, a, b) for a, b in ((0.0, 5.0), (5.0, 5.0), (7.0, 6.0), (2.5, 100.0), (-3.0, -1.0))] + [(2, 0.0, 1.0)]
    right = [(1, a, b) for a, b in ((5.0, 9.0), (-1.0, 0.0), (50.0, 50.0), (9.0, 1.0))]
    l, r = spark.createDataFrame(left, "k long, a double, b double"), spark.createDataFrame(right, "k long, c double, d double")
    want = sorted((k, a, b, c, d) for (k, a, b), (j, c, d) in itertools.product(left, right) if k == j and a <= b and c <= d and not (b < c or a > d))
    for size in (0.5, 3.0, 1e6):
        assert sorted(map(tuple, temporal.overlap_join(l, r, ["k"], ("a", "b"), ("c", "d"), size).select("k", "a", "b", "c", "d").collect())) == want


def test_centroids_in_blocks(spark):
    vectors = spark.createDataFrame([(k, [float(k % 3 == j) + 0.1 * k for j in range(3)]) for k in range(9)], "i long, v array<double>")
    profiles = spark.createDataFrame([(k, [float(k % 3 == j) for j in range(3)]) for k in range(12)], "centroid_id long, centroid array<double>")
    want = sorted(map(tuple, knowledge.centroid_match(vectors, profiles, "i", "v").collect()))
    assert len(want) == 9 and all(c < 3 for _, c, _, _ in want)
    assert sorted(map(tuple, knowledge.centroid_match(vectors, profiles, "i", "v", block_bytes=60).collect())) == want
