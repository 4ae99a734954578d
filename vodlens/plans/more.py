"""More named queries: scans, screen and speech operators, calibration, marts and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.functions import lexicons as L
from vodlens.operators import chat as chat_ops
from vodlens.operators import clips, folds, knowledge, media, search, store, temporal
from vodlens.plans import views as V
from vodlens.plans.catalog import DAY, DENSE, HOUR, STANCE, TERMS, TURNS, _dense, _event_stream, _matrix, _turns, query, r6, r9
from vodlens.plans.views import table


@query("SELECT event_id, event_type, value FROM events ORDER BY ts, event_id LIMIT 40 OFFSET 100")
def page_scan(spark, d):
    return store.page(table(spark, d, "events"), ["ts", "event_id"], 40, 100).select("event_id", "event_type", "value")


@query("WITH $VIEWS SELECT message_id, content FROM chat WHERE stream_id = 3 AND timestamp_offset BETWEEN 86400 AND 864000 ORDER BY timestamp_offset, message_id LIMIT 100")
def chat_range_scan(spark, d):
    c = V.chat(spark, d).where("stream_id = 3").where(F.col("timestamp_offset").between(86400, 864000))
    return store.page(c, ["timestamp_offset", "message_id"], 100).select("message_id", "content")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '1') OR CAST(p_partkey AS VARCHAR) = '7' ORDER BY p_partkey LIMIT 25")
def title_search(spark, d):
    p = table(spark, d, "part")
    return p.where(F.contains(F.lower("p_name"), F.lit("1")) | (F.col("p_partkey").cast("string") == "7")).orderBy("p_partkey").limit(25).select("p_partkey", "p_name")


SITES = " OR ".join(f"contains(lower(m), '{s}')" for s in ["example.com", *L.SITES])


@query("""SELECT page_id, regexp_extract(lower(url), '://([^/?#]+)', 1) AS host, CASE WHEN contains(lower(html), 'killed') OR contains(lower(html), 'defeated') THEN true ELSE false END AS feed FROM pages""")
def screen_context(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract(F.lower("url"), "://([^/?#]+)", 1).alias("host"), C.any_contained(F.lower("html"), ["killed", "defeated"]).alias("feed"))


@query()
def screen_cards(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("text").alias("ocr_text_blocks"))
    return media.screen_cards(docs, ["doc_id"])


@query()
def screen_addresses(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("block"))
    return docs.withColumn("a", media.screen_address(F.concat("block", F.lit(" see https://x.com/a")))).select("doc_id", "a.url", "a.domain").distinct()


@query()
def read_along(spark, d):
    frames = V.speech(spark, d).select("stream_id", F.col("segment_id").alias("frame_index"), F.col("start_sec").alias("timestamp_sec"), F.array("transcript").alias("ocr_text_blocks"))
    return media.read_along(V.speech(spark, d), frames, ["stream_id"]).withColumn("score", r6("score")).withColumn("wpm", r6("wpm"))


@query("""WITH $VIEWS, h AS (SELECT stream_id, segment_id, greatest(0.0, start_sec - 1) AS lo, end_sec + 3 AS hi FROM speech WHERE len(list_filter(regexp_split_to_array(transcript, '\\s+'), lambda x: x <> '')) / greatest(0.2, end_sec - start_sec) >= 0.2),
a AS (SELECT *, max(hi) OVER (PARTITION BY stream_id ORDER BY lo, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM h), b AS (SELECT *, sum(CASE WHEN p IS NULL OR lo > p THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY lo, segment_id) AS i FROM a)
SELECT stream_id, min(lo) AS start_sec, max(hi) AS end_sec, count(*) AS n_rows FROM b GROUP BY stream_id, i""")
def speech_bursts(spark, d):
    s = V.speech(spark, d)
    n = F.size(C.words(F.col("transcript"))) / F.greatest(F.lit(0.2), F.col("end_sec") - F.col("start_sec"))
    return media.speech_bursts(s.where(n >= 0.2), ["stream_id"], 1e12, 0.2)


@query(f"""WITH $VIEWS, {DENSE}, s AS (SELECT *, avg(message_count) OVER w AS m, stddev_pop(message_count) OVER w AS sd FROM dense WINDOW w AS (PARTITION BY stream_id)),
z AS (SELECT stream_id, bucket_index, bucket_index * {HOUR} AS lo, (bucket_index + 1) * {HOUR} AS hi FROM s WHERE message_count > 0 AND ((CASE WHEN sd > 0 THEN (message_count - m) / sd ELSE 0 END) >= 2.5 OR message_count >= 3 * m)),
c AS (SELECT DISTINCT z.stream_id, bucket_index FROM z JOIN keyframes k ON k.stream_id = z.stream_id AND timestamp_sec BETWEEN lo AND hi)
SELECT stream_id, count(*) AS n_bursts, count(c.bucket_index) AS n_covered FROM z LEFT JOIN c USING (stream_id, bucket_index) GROUP BY stream_id""")
def burst_coverage(spark, d):
    b = temporal.z_bursts(_dense(spark, d), ["stream_id"]).select("stream_id", F.col("bucket_index").alias("burst_id"), (F.col("bucket_index") * HOUR).alias("lo"), ((F.col("bucket_index") + 1) * HOUR).alias("hi"))
    return media.burst_coverage(b, V.keyframes(spark, d), ["stream_id"], HOUR)


SPANS = """ga AS (SELECT *, lag(speaker_label) OVER w AS pg, lag(end_sec) OVER w AS pe FROM speech WINDOW w AS (PARTITION BY stream_id ORDER BY start_sec, segment_id)),
gb AS (SELECT *, sum(CASE WHEN pg IS NULL OR speaker_label <> pg OR start_sec - pe > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_sec, segment_id) AS i FROM ga),
gs AS (SELECT stream_id, speaker_label, min(start_sec) AS start_sec, max(end_sec) AS end_sec, sum(end_sec - start_sec) AS spoken_sec FROM gb GROUP BY stream_id, speaker_label, i)"""


@query(f"""WITH $VIEWS, {SPANS}, m AS (SELECT stream_id, segment_id, (start_sec + end_sec) / 2 AS mid FROM speech),
j AS (SELECT m.stream_id, segment_id, speaker_label, row_number() OVER (PARTITION BY m.stream_id, segment_id ORDER BY start_sec, speaker_label) AS k FROM m JOIN gs ON gs.stream_id = m.stream_id AND mid BETWEEN start_sec AND end_sec)
SELECT m.stream_id, m.segment_id, coalesce(speaker_label, 'SPEAKER_00') AS speaker FROM m LEFT JOIN j ON j.stream_id = m.stream_id AND j.segment_id = m.segment_id AND k = 1""")
def speaker_lookup(spark, d):
    """Whose span of the whole recording holds each segment's midpoint first."""
    s = V.speech(spark, d)
    t = media.guests(s, ["stream_id"], "speaker_label").select("stream_id", F.col("speaker_label").alias("turn_id"), F.col("start_sec").alias("turn_start"), F.col("end_sec").alias("turn_end"), F.col("speaker_label").alias("speaker"))
    return media.speaker_at(s, t, ["stream_id"], HOUR).select("stream_id", "segment_id", "speaker")


@query("SELECT event_id, CASE WHEN value >= 0.9 * avg(value) OVER (PARTITION BY user_id) THEN 'STREAMER' ELSE 'EXTERNAL_VIDEO' END AS speaker_label FROM events")
def loud_segments(spark, d):
    return media.loud_segments(table(spark, d, "events"), ["user_id"], "value").select("event_id", "speaker_label")


@query()
def latency_calibration(spark, d):
    c = V.chat(spark, d)
    return media.calibrate_latency(V.speech(spark, d), c, V.bounds(c), ["stream_id"], 60.0, 120.0, 1200.0)


@query()
def rolling_latency(spark, d):
    c = V.chat(spark, d)
    return media.rolling_latency(V.speech(spark, d), c, ["stream_id"], F.lit(0.0), 10 * DAY, 5 * DAY, step=HOUR, low=HOUR, high=9 * HOUR)


@query()
def sampling_savings(spark, d):
    from vodlens.plans.catalog import sampling_times

    out = media.sampling_savings(sampling_times(spark, d), V.bounds(V.chat(spark, d)), ["stream_id"], 300.0)
    return out.withColumn("reduction_pct", r6("reduction_pct")).withColumn("saved_sec", r6("saved_sec"))


@query(f"WITH $VIEWS, w AS (SELECT user_id % 8 AS stream_id, event_id, t AS lo, t + {HOUR} + 2 AS hi FROM ev WHERE event_type = 'click'), n AS (SELECT c.stream_id FROM w JOIN chat c ON c.stream_id = w.stream_id AND timestamp_offset BETWEEN lo AND hi WHERE contains(content, 'KEKW')) SELECT stream_id, 'kekw' AS term, 'HYPE' AS intent, count(*) AS votes FROM n GROUP BY stream_id")
def slang_context(spark, d):
    e = V.events(spark, d).where("event_type = 'click'")
    cand = e.select((F.col("user_id") % 8).alias("stream_id"), F.lit("kekw").alias("term"), F.col("t").alias("window_start"), (F.col("t") + HOUR).alias("window_end"))
    return media.slang_context(cand, V.chat(spark, d), ["stream_id"], HOUR)


@query()
def novel_clusters(spark, d):
    words = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.explode(C.index_tokens(F.col("text"))).alias("term")).distinct()
    return media.novel_clusters(words, ["k"], "term")


@query()
def adaptive_slang(spark, d):
    """Bursts, their context and the folded lexicon, from end to end."""
    from vodlens.plans.catalog import slang_bursts

    found = slang_bursts(spark, d).select("stream_id", F.col("token").alias("term"), "window_start", (F.col("window_start") + 36000).alias("window_end"), "z_score", "n")
    votes = media.slang_context(found, V.chat(spark, d), ["stream_id"], 36000.0)
    weight = C.literal_map(L.INTENT_WEIGHTS)
    mood = votes.groupBy("term").agg((F.sum(F.col("votes") * F.try_element_at(weight, F.col("intent"))) / F.sum("votes")).alias("valence"))
    per = found.groupBy("term").agg(F.max("z_score").alias("peak_z"), F.sum("n").alias("occurrences"))
    batch = per.join(mood, "term", "left").select("term", (0.5 + F.least(F.lit(0.35), F.col("peak_z") * 0.05)).alias("confidence"), F.coalesce("valence", F.lit(0.0)).alias("valence"), "occurrences", "peak_z", F.lit(None).cast("timestamp").alias("last_seen"))
    state = batch.limit(0)
    out = knowledge.upsert_lexicon(state, batch)
    return out.select("term", r6("confidence").alias("confidence"), r6("valence").alias("valence"), "occurrences", r6("peak_z").alias("peak_z"))


@query(f"WITH $VIEWS, {TURNS}, m AS (SELECT *, CASE WHEN contains(transcript, 'loved') THEN 1.0 WHEN contains(transcript, 'terrible') THEN -1.0 ELSE 0.0 END AS s FROM tu), l AS (SELECT *, lag(s) OVER (PARTITION BY stream_id ORDER BY start_sec, segment_id) AS p FROM m) SELECT stream_id, segment_id, s, p FROM l WHERE s * p < -0.1 AND abs(s - p) > 0.6")
def debate_moments(spark, d):
    s = F.when(F.contains("transcript", F.lit("loved")), 1.0).when(F.contains("transcript", F.lit("terrible")), -1.0).otherwise(0.0)
    w = Window.partitionBy("stream_id").orderBy("start_sec", "segment_id")
    t = _turns(spark, d).withColumn("s", s).withColumn("p", F.lag("s").over(w))
    return t.where((F.col("s") * F.col("p") < -0.1) & (F.abs(F.col("s") - F.col("p")) > 0.6)).select("stream_id", "segment_id", "s", "p")


@query("""WITH $VIEWS, a AS (SELECT *, lag(speaker_label) OVER w AS pg, lag(end_sec) OVER w AS pe FROM speech WINDOW w AS (PARTITION BY stream_id ORDER BY start_sec, segment_id)),
b AS (SELECT *, sum(CASE WHEN pg IS NULL OR speaker_label <> pg OR start_sec - pe > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_sec, segment_id) AS i FROM a)
SELECT stream_id, speaker_label, min(start_sec) AS start_sec, max(end_sec) AS end_sec, sum(end_sec - start_sec) AS spoken_sec FROM b GROUP BY stream_id, speaker_label, i""")
def guest_interactions(spark, d):
    return media.guests(V.speech(spark, d), ["stream_id"], "speaker_label")


@query("WITH $VIEWS SELECT message_id, round(timestamp_offset, 6) AS t FROM chat WHERE length(content) > 16")
def trigger_times(spark, d):
    return V.chat(spark, d).where(F.length("content") > 16).select("message_id", r6("timestamp_offset").alias("t"))


@query("WITH $VIEWS, g AS (SELECT user_id, avg(CASE WHEN contains(content, 'KEKW') OR contains(content, 'trash') THEN 1.0 ELSE 0.0 END) AS b FROM chat GROUP BY user_id) SELECT user_id, round(1 / (1 + exp(-(-2.5 * b - 1.5))), 6) AS griefer_score FROM g WHERE 1 / (1 + exp(-(-2.5 * b - 1.5))) >= 0.09")
def flagged_griefers(spark, d):
    return chat_ops.profiles(V.chat(spark, d)).where("griefer_score >= 0.09").select("user_id", r6("griefer_score").alias("griefer_score"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-12-01')::INT AS age FROM orders WHERE o_orderstatus = 'F' AND date_diff('day', o_orderdate::DATE, DATE '1998-12-01') >= 1000")
def retention(spark, d):
    age = F.datediff(F.lit("1998-12-01").cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").withColumn("age", age).where("age >= 1000").select("o_orderkey", "age")


@query("SELECT c_custkey, platform, CASE WHEN platform IN ('YOUTUBE', 'TIKTOK') THEN 'SUCCESS' ELSE 'UNSUPPORTED_PLATFORM' END AS status FROM customer, (VALUES ('YOUTUBE'), ('TIKTOK'), ('MYSPACE')) p(platform)")
def publish_dispatch(spark, d):
    return clips.publish(table(spark, d, "customer").select("c_custkey"), ["YOUTUBE", "TIKTOK", "MYSPACE"])


@query("SELECT source, lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source, lang")
def chunk_stats(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT (SELECT count(*) FROM customer) AS n_targets, count(*) AS n_vods, count(*) FILTER (o_orderstatus = 'O') AS n_queued, count(*) FILTER (o_orderstatus = 'F') AS n_done, round(sum(o_totalprice), 2) AS total FROM orders""")
def overview_stats(spark, d):
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_vods"), n("O").alias("n_queued"), n("F").alias("n_done"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n_targets")).crossJoin(o)  # two single rows


@query("""WITH u AS (SELECT l_returnflag AS class, sum(l_quantity) AS used, count(*) AS n FROM lineitem GROUP BY l_returnflag)
SELECT class, n, round(100 * used / sum(used) OVER (), 6) AS pct, CASE WHEN 100 * used / sum(used) OVER () >= 100 THEN 'CRITICAL' WHEN 100 * used / sum(used) OVER () >= 85 THEN 'WARNING' ELSE 'OK' END AS level FROM u""")
def storage_report(spark, d):
    u = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("class")).agg(F.sum("l_quantity").alias("used"), F.count(F.lit(1)).alias("n"))
    every = table(spark, d, "lineitem").agg(F.sum("l_quantity").alias("every"))  # one row
    u = u.crossJoin(F.broadcast(every))
    return u.withColumn("p", 100 * F.col("used") / F.col("every")).select("class", "n", r6("p").alias("pct"), media.storage_level(F.col("p"), F.lit(1000.0)).alias("level"))


@query("WITH $VIEWS, s AS (SELECT stream_id, 'speech' AS content_type, 'speech_' || segment_id AS chunk_id, start_sec AS t FROM speech UNION ALL SELECT stream_id, 'ocr', 'ocr_' || frame_index, timestamp_sec FROM keyframes WHERE len(ocr_text_blocks) > 0 UNION ALL SELECT stream_id, 'chat', 'chat_' || message_id, timestamp_offset FROM chat WHERE contains(content, 'cringe')) SELECT stream_id, content_type, chunk_id, round(t, 6) AS t FROM s")
def index_chunks(spark, d):
    s = V.speech(spark, d).select("stream_id", F.lit("speech").alias("content_type"), F.concat(F.lit("speech_"), F.col("segment_id").cast("string")).alias("chunk_id"), F.col("start_sec").alias("t"))
    k = V.keyframes(spark, d).where(F.size("ocr_text_blocks") > 0).select("stream_id", F.lit("ocr").alias("content_type"), F.concat(F.lit("ocr_"), F.col("frame_index").cast("string")).alias("chunk_id"), F.col("timestamp_sec").alias("t"))
    c = V.chat(spark, d).where(F.contains("content", F.lit("cringe"))).select("stream_id", F.lit("chat").alias("content_type"), F.concat(F.lit("chat_"), F.col("message_id").cast("string")).alias("chunk_id"), F.col("timestamp_offset").alias("t"))
    return s.unionByName(k).unionByName(c).withColumn("t", r6("t"))


@query()
def rag_answer(spark, d):
    docs = table(spark, d, "documents")
    scores = search.bm25(docs, "doc_id", "text", TERMS).join(docs.select("doc_id", "text", "source", "lang"), "doc_id")
    e = search.evidence(scores.withColumn("score", r6("score")), "source", "lang", "text", "score", "doc_id", {"en": 2, "fr": 1, "de": 1})
    line = F.concat(F.lit("- ["), F.col("source"), F.lit("] "), F.col("quote"))
    return e.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"), F.count(F.lit(1)).alias("n_citations"))


@query()
def timeline_bundle(spark, d):
    m = _matrix(spark, d)
    scenes = m.groupBy("stream_id").agg(F.countDistinct("active_scene_type").alias("n_scenes"), F.sum(F.col("is_spike_moment").cast("long")).alias("n_spikes"), F.avg("agreement_score").alias("agreement"), F.count(F.lit(1)).alias("n_slices"))
    said = V.speech(spark, d).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_segments"))
    return scenes.join(said, "stream_id", "left").withColumn("agreement", r9("agreement"))


@query()
def subtitle_events(spark, d):
    from vodlens.plans.catalog import caption_lines

    return media.subtitle_lines(caption_lines(spark, d), ["stream_id"])


@query()
def youtube_package(spark, d):
    """Thinned chapters with their labels."""
    m = _matrix(spark, d).where("chat_message_count >= 3").select("stream_id", "bucket_index", "start_sec", "active_scene_type")
    kept = folds.thinned(m, ["stream_id"], "start_sec", "bucket_index", DAY).join(m.drop("start_sec"), ["stream_id", "bucket_index"])
    return kept.select("stream_id", "bucket_index", F.concat_ws(" ", C.clock(F.col("start_sec")), F.initcap(F.replace("active_scene_type", F.lit("_"), F.lit(" ")))).alias("chapter"))


@query(f"WITH $VIEWS SELECT user_id, max({STANCE}::DOUBLE) AS best, arg_max(event_id, struct_pack(a := t, b := event_id)) AS last_event FROM ev GROUP BY user_id")
def point_state(spark, d):
    rows = V.events(spark, d).withColumn("v", F.expr(STANCE).cast("double"))
    return rows.groupBy("user_id").agg(F.max("v").alias("best"), F.max_by("event_id", F.struct("t", "event_id")).alias("last_event"))


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    from vodlens.streaming import live

    out = live.run_available(live.sessions(_event_stream(spark, d), ["user_id"], "ts", "12 hours", "60 days"), "sessions", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
