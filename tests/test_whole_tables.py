"""Queries that must read whole tables, against plain counts."""

from collections import Counter, defaultdict
from math import ceil, floor

from vodlens.operators import knowledge, media
from vodlens.plans import catalog
from vodlens.plans import views as V


def test_interval_overlap_has_every_hour(spark, tmp_path):
    rows = [(conv, turn, "user", "x" * conv) for conv in (0, 900, 5_000) for turn in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = defaultdict(int)
    for r in V.speech(spark, str(tmp_path)).collect():
        for k in range(floor(r.start_sec / 3600), ceil(r.end_sec / 3600)):
            want[r.stream_id, k] += 1
    got = {(r.stream_id, r.bucket_index): r.n_segments for r in catalog.queries()["interval_overlap"](spark, str(tmp_path)).collect()}
    assert got == dict(want) and max(k for _, k in got) > 800


def test_caption_lines_hold_every_word(spark, data):
    want = sorted(w for r in V.speech(spark, data).collect() for w in r.transcript.split())
    lines = catalog.queries()["caption_lines"](spark, data).collect()
    events = catalog.queries()["subtitle_events"](spark, data).collect()
    assert sorted(w for r in lines for w in r.text.split()) == want
    assert sorted(w for r in events for w in r.event.split(",,0,0,0,,", 1)[1].split()) == want


def test_audit_reads_speech_and_claims(spark):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    c = frame([(1, k, 100.0 * k, 100.0 * k + 50) for k in range(1, 6)], "s long, candidate_id long, start_sec double, end_sec double")
    chat = frame([(1, 510.0, "bad")], "s long, t double, text string")
    said = frame([(1, 90.0, 100.0, "Bad"), (1, 220.0, 230.0, "bad worse"), (1, 260.0, 290.0, "bad")], "s long, start_sec double, end_sec double, transcript string")
    claims = frame([(1, 400.0, "DEBUNKED"), (1, 310.0, "VERIFIED_TRUE")], "s long, t double, verification_status string")
    out = knowledge.policy_audit(c, chat, ["s"], ["bad", "worse"], speech=said, checked=claims)
    assert {r.candidate_id: r.audit_status for r in out.collect()} == {1: "FLAGGED", 2: "REJECTED", 3: "PASSED", 4: "FLAGGED", 5: "FLAGGED"}


def test_influence_counts_the_seeds_of_memes(spark, data):
    authors = {r.message_id: r.author_name for r in V.chat(spark, data).collect()}
    want = Counter(authors[r.seed] for r in catalog.queries()["meme_bursts"](spark, data).collect())
    got = {r.author_name: r.origins for r in catalog.queries()["chatter_influence"](spark, data).collect()}
    assert {a: n for a, n in got.items() if n} == dict(want)


def test_latency_is_calibrated_on_all_days(spark, data, monkeypatch):
    seen = []
    monkeypatch.setattr(media, "calibrate_latency", lambda speech, chat, *rest: seen.append(chat.count()))
    catalog.queries()["latency_calibration"](spark, data)
    assert seen == [V.chat(spark, data).count()]
