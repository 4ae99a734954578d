"""The catalogue of named queries over the driver's tables, each with DuckDB SQL for the same rows.

Results that are real numbers are rounded to six places in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.functions import lexicons as L
from vodlens.operators import chat as chat_ops
from vodlens.operators import costream, folds, fusion, islands, knowledge, search, sponsor, store, temporal
from vodlens.plans import views as V
from vodlens.plans.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR, DAY = 3600.0, 86400.0
#: A block of time: what one task takes of a key in the ordered scans.
WEEK = 7 * DAY


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("$VIEWS", V.SQL.strip())
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r9(c: str) -> Column:
    """For means of few short decimals, which often lie exactly between two six-place numbers."""
    return F.round(F.col(c), 9)


# ---- buckets, spines, spikes -------------------------------------------------------------------

DENSE = f"""spine AS (SELECT stream_id, unnest(generate_series(0, floor(duration / {HOUR})::BIGINT)) AS bucket_index FROM bounds),
counts AS (SELECT stream_id, floor(greatest(0.0, timestamp_offset - 4.5) / {HOUR})::BIGINT AS bucket_index, count(*) AS n FROM chat GROUP BY ALL),
dense AS (SELECT stream_id, bucket_index, coalesce(n, 0) AS message_count, coalesce(n, 0) / {HOUR} AS velocity FROM spine LEFT JOIN counts USING (stream_id, bucket_index))"""


def _dense(spark: SparkSession, d: str) -> DataFrame:
    chat = V.chat(spark, d)
    return temporal.tumbling_counts(chat, V.bounds(chat), ["stream_id"], "timestamp_offset", HOUR, 4.5)


@query(f"WITH $VIEWS, {DENSE} SELECT stream_id, bucket_index, message_count, round(velocity, 6) AS velocity, velocity >= greatest(0.0005, 2.2 * avg(velocity) OVER (PARTITION BY stream_id)) AS is_spike FROM dense")
def chat_bucket_velocity(spark, d):
    out = temporal.spikes(_dense(spark, d), ["stream_id"], 0.0005)
    return out.select("stream_id", "bucket_index", "message_count", r6("velocity").alias("velocity"), "is_spike")


@query(f"""WITH $VIEWS, {DENSE}, s AS (SELECT *, avg(message_count) OVER w AS m, stddev_pop(message_count) OVER w AS sd FROM dense WINDOW w AS (PARTITION BY stream_id))
SELECT stream_id, bucket_index, message_count, round(CASE WHEN sd > 0 THEN (message_count - m) / sd ELSE 0 END, 6) AS z_score FROM s
WHERE message_count > 0 AND ((CASE WHEN sd > 0 THEN (message_count - m) / sd ELSE 0 END) >= 2.5 OR message_count >= 3 * m)""")
def zscore_bursts(spark, d):
    return temporal.z_bursts(_dense(spark, d), ["stream_id"]).select("stream_id", "bucket_index", "message_count", r6("z_score").alias("z_score"))


LEXICON = ", ".join(f"('{k}', {v})" for k, v in L.EMOTE_POLARITY.items())


@query(f"""WITH $VIEWS, lex(token, p) AS (VALUES {LEXICON}),
w AS (SELECT stream_id, floor(timestamp_offset / {DAY})::BIGINT AS bucket_index, unnest(string_split(content, ' ')) AS token FROM chat)
SELECT stream_id, bucket_index, count(p) AS n_hits, round(coalesce(sum(p) / nullif(count(p), 0), 0), 9) AS sentiment FROM w LEFT JOIN lex USING (token) GROUP BY ALL""")
def bucket_sentiment(spark, d):
    out = chat_ops.bucket_sentiment(V.chat(spark, d), ["stream_id"], width=DAY)
    return out.select("stream_id", "bucket_index", F.col("n_hits").cast("long").alias("n_hits"), r9("sentiment").alias("sentiment"))


@query(f"""WITH $VIEWS, w AS (SELECT stream_id, floor(timestamp_offset / {DAY})::BIGINT AS bucket_index, timestamp_offset, message_id, unnest(string_split(content, ' ')) AS token, generate_subscripts(string_split(content, ' '), 1) AS place FROM chat),
c AS (SELECT stream_id, bucket_index, token, count(*) AS n, min(struct_pack(a := timestamp_offset, b := message_id, c := place)) AS first FROM w GROUP BY ALL)
SELECT stream_id, bucket_index, rank, token, n FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, bucket_index ORDER BY n DESC, first)::INT AS rank FROM c) WHERE rank <= 5""")
def bucket_top_tokens(spark, d):
    return chat_ops.top_tokens(V.chat(spark, d), ["stream_id"], width=DAY)


@query(f"""WITH $VIEWS, h AS (SELECT stream_id, message_id, timestamp_offset AS t, unnest(generate_series(greatest(0, floor((timestamp_offset - 36000) / 18000)::BIGINT + 1), floor(timestamp_offset / 18000)::BIGINT)) AS k FROM chat)
SELECT stream_id, (k * 18000)::DOUBLE AS window_start, (k * 18000 + 36000)::DOUBLE AS window_end, count(*) AS n FROM h GROUP BY ALL""")
def sliding_windows(spark, d):
    out = temporal.sliding(V.chat(spark, d), F.col("timestamp_offset"), 36000.0, 18000.0)
    return out.groupBy("stream_id", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n"))


# ---- joins ------------------------------------------------------------------------------------


@query(f"""WITH $VIEWS, l AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'purchase'), r AS (SELECT event_id AS r_id, user_id, t AS r_t FROM ev WHERE event_type = 'click')
SELECT l.event_id, l.user_id, round(l.t, 6) AS t, CASE WHEN r_t - t <= {DAY} THEN r_id END AS r_event_id, round(CASE WHEN r_t - t <= {DAY} THEN r_t END, 6) AS r_t
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t <= r.r_t""")
def asof_reaction(spark, d):
    e = V.events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("event_id", "user_id", "t")
    out = temporal.asof_forward(left, right, ["user_id"], "t", "t", DAY, "event_id", ["event_id"], WEEK)
    return out.select("event_id", "user_id", r6("t").alias("t"), "r_event_id", r6("r_t").alias("r_t"))


@query(f"""WITH $VIEWS, b AS (SELECT *, unnest(generate_series(floor(start_sec / {HOUR})::BIGINT, ceil(end_sec / {HOUR})::BIGINT)) AS k FROM speech)
SELECT stream_id, k AS bucket_index, count(*) AS n_segments, count(DISTINCT speaker_label) AS n_speakers FROM b WHERE greatest(k * {HOUR}, start_sec) < least((k + 1) * {HOUR}, end_sec) GROUP BY ALL""")
def interval_overlap(spark, d):
    out = temporal.overlap_buckets(V.speech(spark, d), "start_sec", "end_sec", HOUR)
    return out.groupBy("stream_id", F.col("bucket_index").cast("long").alias("bucket_index")).agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("speaker_label").alias("n_speakers"))


@query(f"""WITH $VIEWS, w AS (SELECT event_id AS w_id, user_id, t - {HOUR} AS lo, t + {HOUR} AS hi FROM ev WHERE event_type = 'signup')
SELECT w_id, count(*) AS n, round(sum(value), 4) AS total FROM w JOIN ev e ON e.user_id = w.user_id AND e.t BETWEEN lo AND hi GROUP BY w_id""")
def range_window_reaction(spark, d):
    e = V.events(spark, d)
    w = e.where("event_type = 'signup'").select(F.col("event_id").alias("w_id"), "user_id", (F.col("t") - HOUR).alias("lo"), (F.col("t") + HOUR).alias("hi"))
    out = temporal.range_join(e.select("user_id", "t", "value"), w, ["user_id"], "t", "lo", "hi", 2 * HOUR)
    return out.groupBy("w_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH $VIEWS, l AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'error'), p AS (SELECT event_id AS n_id, user_id, t AS n_ts FROM ev WHERE event_type = 'purchase')
SELECT event_id, n_id, round(n_ts - t, 6) AS diff FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(n_ts - t), n_ts, n_id) AS k FROM l JOIN p USING (user_id) WHERE abs(n_ts - t) <= {DAY}) WHERE k = 1""")
def nearest_event(spark, d):
    e = V.events(spark, d)
    left = e.where("event_type = 'error'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("p_id"), "user_id", F.col("t").alias("p_t"))
    return temporal.nearest(left, right, ["user_id"], "t", "p_t", DAY, "p_id").select("event_id", "n_id", r6(F.col("n_ts") - F.col("t")).alias("diff"))


@query(f"""WITH $VIEWS, sp AS (SELECT stream_id, unnest(generate_series(0, floor(duration / {HOUR})::BIGINT)) AS bucket_index FROM bounds),
f AS (SELECT stream_id, floor(timestamp_sec / {HOUR})::BIGINT AS bucket_index, arg_max(scene_type, frame_index) AS s FROM keyframes GROUP BY ALL)
SELECT stream_id, bucket_index, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY bucket_index ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS scene FROM sp LEFT JOIN f USING (stream_id, bucket_index)""")
def locf_state(spark, d):
    dense = temporal.spine(V.bounds(V.chat(spark, d)), ["stream_id"], HOUR)
    frames = V.keyframes(spark, d).withColumn("bucket_index", temporal.bucket(F.col("timestamp_sec"), HOUR)).groupBy("stream_id", "bucket_index").agg(F.max_by("scene_type", "frame_index").alias("scene"))
    out = temporal.carry_forward(dense.join(frames, ["stream_id", "bucket_index"], "left"), ["stream_id"], "bucket_index", ["scene"], WEEK / HOUR)
    return out.select("stream_id", "bucket_index", F.coalesce("scene", F.lit("UNKNOWN")).alias("scene"))


AGREE = ", ".join(f"'{t}'" for t in L.AGREEMENT_TOKENS)
DISSENT = ", ".join(f"'{t}'" for t in L.DISSENT_TOKENS)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    chat = V.chat(spark, d)
    return fusion.build_matrix(chat, V.speech(spark, d), V.keyframes(spark, d), V.bounds(chat), ["stream_id"], HOUR, 4.5)


@query(f"""WITH $VIEWS, {DENSE}, lex(token, p) AS (VALUES {LEXICON}),
w AS (SELECT stream_id, floor(greatest(0.0, timestamp_offset - 4.5) / {HOUR})::BIGINT AS bucket_index, timestamp_offset AS a, message_id AS b, unnest(string_split(content, ' ')) AS token, generate_subscripts(string_split(content, ' '), 1) AS c FROM chat),
mood AS (SELECT stream_id, bucket_index, coalesce(sum(p) / nullif(count(p), 0), 0) AS sentiment FROM w LEFT JOIN lex USING (token) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, bucket_index ORDER BY n DESC, first) AS r FROM (SELECT stream_id, bucket_index, token, count(*) AS n, min(struct_pack(a := a, b := b, c := c)) AS first FROM w GROUP BY ALL)) WHERE r <= 5),
votes AS (SELECT stream_id, bucket_index, coalesce(sum(n) FILTER (token IN ({AGREE})), 0) AS ag, coalesce(sum(n) FILTER (token IN ({DISSENT})), 0) AS di FROM top GROUP BY ALL),
sp AS (SELECT stream_id, bucket_index, bool_or(speaker_label = 'STREAMER') AS spoke, count(DISTINCT speaker_label) AS n_speakers FROM dense d JOIN speech s USING (stream_id) WHERE greatest(bucket_index * {HOUR}, start_sec) < least((bucket_index + 1) * {HOUR}, end_sec) GROUP BY ALL),
f AS (SELECT stream_id, floor(timestamp_sec / {HOUR})::BIGINT AS bucket_index, arg_max(scene_type, frame_index) AS s FROM keyframes GROUP BY ALL),
j AS (SELECT d.*, coalesce(sentiment, 0) AS sentiment, coalesce(ag, 0) AS ag, coalesce(di, 0) AS di, coalesce(spoke, false) AS spoke, coalesce(n_speakers, 0) AS n_speakers,
  coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY d.stream_id ORDER BY d.bucket_index ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS active_scene_type
  FROM dense d LEFT JOIN mood USING (stream_id, bucket_index) LEFT JOIN votes USING (stream_id, bucket_index) LEFT JOIN sp USING (stream_id, bucket_index) LEFT JOIN f USING (stream_id, bucket_index))
SELECT stream_id, bucket_index, n_speakers::INT AS n_speakers, active_scene_type, message_count AS chat_message_count, round(sentiment, 9) AS sentiment, velocity >= greatest(2.0, 2.2 * avg(velocity) OVER (PARTITION BY stream_id)) AS is_spike_moment,
  round(CASE WHEN spoke AND ag + di > 0 THEN (ag - di) / (ag + di) WHEN spoke AND message_count > 2 THEN sentiment END, 9) AS agreement_score FROM j""")
def fusion_matrix(spark, d):
    m = _matrix(spark, d)
    return m.select("stream_id", "bucket_index", F.size("active_speakers").alias("n_speakers"), "active_scene_type", "chat_message_count", r9("chat_sentiment_polarity").alias("sentiment"), "is_spike_moment", r9("agreement_score").alias("agreement_score"))


@query()
def fusion_highlights(spark, d):
    m = _matrix(spark, d).withColumn("is_spike_moment", F.col("chat_message_count") >= 3)
    return fusion.highlights(m).select("stream_id", "bucket_index", "clip_start", "clip_end", "alignment_label")


@query()
def fusion_export(spark, d):
    m = fusion.flat_export(_matrix(spark, d))
    return m.withColumns({c: r9(c) for c in ("chat_velocity_per_sec", "chat_sentiment_polarity", "agreement_score")})


@query()
def training_triples(spark, d):
    return fusion.training_triples(_matrix(spark, d).withColumn("chat_sentiment_polarity", r6("chat_sentiment_polarity")))


# ---- islands and change detection --------------------------------------------------------------


@query(f"""WITH $VIEWS, a AS (SELECT *, lag(t) OVER w AS p FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > {DAY / 2} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM a)
SELECT user_id, round(min(t), 6) AS start_sec, round(max(t), 6) AS end_sec, count(*) AS n_rows FROM b GROUP BY user_id, i""")
def gap_islands(spark, d):
    out = islands.gap_islands(V.events(spark, d), ["user_id"], "t", "t", ["t", "event_id"], DAY / 2, WEEK)
    return out.select("user_id", r6("start_sec").alias("start_sec"), r6("end_sec").alias("end_sec"), "n_rows")


@query("""WITH $VIEWS, a AS (SELECT *, max(end_sec) OVER (PARTITION BY stream_id ORDER BY start_sec, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM speech),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR start_sec > p THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_sec, segment_id) AS i FROM a)
SELECT stream_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) AS n_rows FROM b GROUP BY stream_id, i""")
def merge_intervals(spark, d):
    return islands.merge_intervals(V.speech(spark, d), ["stream_id"], "start_sec", "end_sec", ["start_sec", "segment_id"], WEEK)


@query(f"""WITH $VIEWS, a AS (SELECT *, lead(t, 2) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev)
SELECT user_id, round(coalesce(min(t) FILTER (k - t <= {HOUR * 6}), min(t)), 6) AS arrival, min(t) FILTER (k - t <= {HOUR * 6}) IS NOT NULL AS is_burst FROM a GROUP BY user_id""")
def k_burst(spark, d):
    return islands.first_burst(V.events(spark, d), ["user_id"], "t", ["t", "event_id"], 3, HOUR * 6).select("user_id", r6("arrival").alias("arrival"), "is_burst")


STANCE = "CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END"


@query(f"""WITH $VIEWS, a AS (SELECT user_id, event_id, {STANCE}::DOUBLE AS v, lag({STANCE}::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev)
SELECT user_id, event_id, p AS previous, v, v - p AS delta, v * p < 0 AS is_reversal FROM a WHERE p IS NOT NULL AND abs(v - p) >= 0.5""")
def stance_shifts(spark, d):
    rows = V.events(spark, d).withColumn("v", F.expr(STANCE).cast("double"))
    return islands.shifts(rows, ["user_id"], "v", ["t", "event_id"], block=WEEK).select("user_id", "event_id", "previous", "v", "delta", "is_reversal")


@query(f"""WITH $VIEWS, a AS (SELECT user_id, abs({STANCE}::DOUBLE - lag({STANCE}::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS s FROM ev)
SELECT user_id, count(*) AS n_rows, round(CASE WHEN count(*) < 2 THEN 0 ELSE least(1.0, coalesce(sum(s), 0) / (2.0 * (count(*) - 1))) END, 6) AS volatility FROM a GROUP BY user_id""")
def stance_volatility(spark, d):
    rows = V.events(spark, d).withColumn("v", F.expr(STANCE).cast("double"))
    return islands.volatility(rows, ["user_id"], "v", ["t", "event_id"], block=WEEK).select("user_id", "n_rows", r6("volatility").alias("volatility"))


@query(f"""WITH $VIEWS, a AS (SELECT user_id, {STANCE}::DOUBLE AS v, lag({STANCE}::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM ev)
SELECT user_id, round(avg(v), 6) AS mean_stance, count(*) AS n, count(*) FILTER (p * v < 0) AS contradictions, CASE WHEN avg(v) >= 0.35 THEN 'POSITIVE' WHEN avg(v) <= -0.35 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS consensus FROM a GROUP BY user_id""")
def opinion_consensus(spark, d):
    rows = islands.lagged(V.events(spark, d).withColumn("v", F.expr(STANCE).cast("double")), ["user_id"], ["t", "event_id"], WEEK, p="v")
    out = rows.groupBy("user_id").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col("p") * F.col("v") < 0).cast("long"), F.lit(0))).alias("contradictions"))
    return out.select("user_id", r6("m").alias("mean_stance"), "n", "contradictions", knowledge.stance_of(F.col("m"), names=("POSITIVE", "NEGATIVE", "NEUTRAL")).alias("consensus"))


TURNS = """tu AS (SELECT *, coalesce(speaker_label <> lag(speaker_label) OVER w AND start_sec < lag(end_sec) OVER w - 0.3, false) AS cuts FROM speech WHERE end_sec - start_sec >= 0.5 WINDOW w AS (PARTITION BY stream_id ORDER BY start_sec, segment_id))"""


def _turns(spark, d):
    return islands.turns(V.speech(spark, d), ["stream_id"], "speaker_label", "start_sec", "end_sec", ["start_sec", "segment_id"], block=WEEK)


@query(f"WITH $VIEWS, {TURNS} SELECT stream_id, segment_id, speaker_label, start_sec, end_sec, cuts AS interrupts_previous FROM tu")
def debate_turns(spark, d):
    return _turns(spark, d).select("stream_id", "segment_id", "speaker_label", "start_sec", "end_sec", "interrupts_previous")


@query(f"""WITH $VIEWS, {TURNS} SELECT stream_id, speaker_label, sum(end_sec - start_sec) AS talk_sec, count(*) AS n_turns, count(*) FILTER (cuts) AS n_interrupts,
round(100 * sum(end_sec - start_sec) / sum(sum(end_sec - start_sec)) OVER (PARTITION BY stream_id), 6) AS talk_pct FROM tu GROUP BY stream_id, speaker_label""")
def talk_share(spark, d):
    out = islands.talk_share(_turns(spark, d), ["stream_id"], "speaker_label", "start_sec", "end_sec")
    return out.withColumn("talk_pct", r6("talk_pct"))


@query(f"""WITH $VIEWS, h AS (SELECT user_id % 8 AS k, floor(t / {HOUR})::BIGINT AS bin, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'purchase') AS b FROM ev GROUP BY ALL),
z AS (SELECT k, bin, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS b FROM h WINDOW w AS (PARTITION BY k)),
c AS (SELECT x.k, lag, sum(x.a * y.b) AS score, count(*) AS n_bins FROM z x CROSS JOIN generate_series(0, 24) g(lag) JOIN z y ON y.k = x.k AND y.bin = x.bin + lag GROUP BY ALL)
SELECT k, lag::INT AS lag, round(score, 6) AS score, n_bins FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, lag) AS r FROM c) WHERE r = 1""")
def lag_correlation(spark, d):
    e = V.events(spark, d)
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    h = e.groupBy((F.col("user_id") % 8).alias("k"), F.floor(F.col("t") / HOUR).alias("bin")).agg(n("click").alias("a"), n("purchase").alias("b"))
    return temporal.best_lag(h, ["k"], 0, 24).withColumn("score", r6("score"))


# ---- chat -------------------------------------------------------------------------------------


@query("""WITH $VIEWS SELECT intent AS primary_intent, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM
(SELECT CASE split_part(content, ' ', 1) WHEN 'KEKW' THEN 'AMUSEMENT' WHEN 'TRUE' THEN 'AGREEMENT' WHEN 'buying' THEN 'NEUTRAL' WHEN 'why' THEN 'QUESTION' ELSE 'DISGUST_CRINGE' END AS intent FROM chat) GROUP BY intent""")
def intent_histogram(spark, d):
    per = chat_ops.intents(V.chat(spark, d), ["message_id"]).groupBy("primary_intent").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("pct", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


GRIEF = """g AS (SELECT user_id, count(*) AS total_messages, count(*) FILTER (content LIKE '%trash%')::DOUBLE / count(*) AS b0, 0.0 AS h FROM chat GROUP BY user_id)"""


@query("""WITH $VIEWS, g AS (SELECT user_id, count(*) AS total_messages, avg(CASE WHEN contains(content, 'KEKW') OR contains(content, 'trash') THEN 1.0 ELSE 0.0 END) AS b FROM chat GROUP BY user_id)
SELECT user_id, total_messages, 0.0::DOUBLE AS hostility_index, round(b, 6) AS banter_reciprocity, round(1 / (1 + exp(-(-2.5 * b - 1.5))), 6) AS griefer_score, 'CLEAN' AS flagged_status, false AS is_automated_bot FROM g""")
def chatter_profiles(spark, d):
    p = chat_ops.profiles(V.chat(spark, d))
    return p.select("user_id", "total_messages", r6("hostility_index").alias("hostility_index"), r6("banter_reciprocity").alias("banter_reciprocity"), r6("griefer_score").alias("griefer_score"), "flagged_status", "is_automated_bot")


@query()
def chatter_influence(spark, d):
    chat, talk = V.chat(spark, d), V.speech(spark, d)
    origins = chat.join(meme_bursts(spark, d).select(F.col("seed").alias("message_id")), "message_id").select("author_name")
    out = chat_ops.influence(chat, origins, chat_ops.responses(chat, talk, ["stream_id"], longest=1800.0))
    return out.withColumn("influence_score", r6("influence_score")).drop("user_id")


@query("WITH $VIEWS SELECT message_id, CASE WHEN contains(content, 'KEKW') OR contains(content, 'trash') THEN 'GOOD_NATURED_BANTER' ELSE 'BENIGN_CHAT' END AS verdict FROM chat")
def safety_verdicts(spark, d):
    return V.chat(spark, d).select("message_id", chat_ops.safety_verdict(F.col("content"))["verdict"].alias("verdict"))


# ---- sponsors ---------------------------------------------------------------------------------

BRANDS = [{"brand_id": "nord", "brand_name": "NordVPN", "aliases": ["Nord VPN"], "promo_codes": [], "product_keywords": []}]
MENTIONS = """men AS (SELECT stream_id, 'nord' AS brand_id, 'audio' AS kind, start_sec, end_sec, transcript AS text FROM speech WHERE contains(transcript, 'NordVPN')
UNION ALL SELECT stream_id, 'nord', 'ocr', timestamp_sec, timestamp_sec, unnest(ocr_text_blocks) FROM keyframes),
seg0 AS (SELECT *, lag(end_sec) OVER (PARTITION BY stream_id ORDER BY start_sec, kind, end_sec, text) AS p FROM men),
seg1 AS (SELECT *, sum(CASE WHEN p IS NULL OR start_sec - p > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_sec, kind, end_sec, text) AS segment_id FROM seg0),
seg AS (SELECT stream_id, brand_id, segment_id::BIGINT AS segment_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, count(*) FILTER (kind = 'audio') AS n_audio, count(*) FILTER (kind = 'ocr') AS n_ocr FROM seg1 GROUP BY ALL)"""


def _segments(spark, d):
    found = sponsor.mentions(V.speech(spark, d), V.keyframes(spark, d), ["stream_id"], BRANDS)
    return sponsor.segments(found, ["stream_id"], 3600.0)


@query(f"WITH $VIEWS, {MENTIONS} SELECT stream_id, brand_id, segment_id, round(start_sec, 6) AS start_sec, round(end_sec, 6) AS end_sec, n_audio, n_ocr FROM seg")
def sponsor_segments(spark, d):
    return _segments(spark, d).withColumn("start_sec", r6("start_sec")).withColumn("end_sec", r6("end_sec"))


@query(f"""WITH $VIEWS, {MENTIONS}, lex(token, p) AS (VALUES {LEXICON}),
m AS (SELECT c.*, s.p, s.h, contains(content, 'code') AS about, contains(content, 'cringe') AS back FROM chat c JOIN (SELECT message_id, coalesce(sum(p), 0) AS p, count(p) AS h FROM (SELECT message_id, unnest(string_split(content, ' ')) AS token FROM chat) LEFT JOIN lex USING (token) GROUP BY message_id) s USING (message_id)),
base AS (SELECT stream_id, coalesce(sum(p) / nullif(sum(h), 0), 0) AS baseline FROM m GROUP BY stream_id),
w AS (SELECT *, greatest(0.0, start_sec - 3600) AS lo, end_sec + 3600 AS hi FROM seg),
j AS (SELECT w.stream_id, segment_id, lo, hi, count(message_id) AS n_messages, coalesce(sum(p) / nullif(sum(h), 0), 0) AS mood, count(*) FILTER (about) AS mentions, count(*) FILTER (back) AS backlash FROM w LEFT JOIN m ON m.stream_id = w.stream_id AND timestamp_offset BETWEEN lo AND hi GROUP BY ALL)
SELECT stream_id, segment_id, n_messages, mentions, round(mood, 9) AS mood, round(mood - baseline, 9) AS sentiment_delta, round(coalesce(backlash / nullif(n_messages, 0), 0), 6) AS backlash_index,
round(greatest(0, least(100, 100 * (0.4 * least(1.0, mentions / 50.0) + 0.3 * ((mood + 1) / 2) + 0.3 * greatest(0, 1 - coalesce(backlash / nullif(n_messages, 0), 0))))), 6) AS attention_score FROM j JOIN base USING (stream_id)""")
def sponsor_impact(spark, d):
    out = sponsor.impact(V.chat(spark, d), _segments(spark, d), ["stream_id"], {"nord": ["nordvpn", "nord vpn", "code"]}, HOUR)
    return out.select("stream_id", "segment_id", "n_messages", "mentions", r9("mood").alias("mood"), r9("sentiment_delta").alias("sentiment_delta"), r6("backlash_index").alias("backlash_index"), r6("attention_score").alias("attention_score"))


@query()
def sponsor_contract_audit(spark, d):
    out = sponsor.contract_audit(V.chat(spark, d), V.speech(spark, d), _segments(spark, d), ["stream_id"], "nord", ["NordVPN", "story"], "LUCKY", 600.0)
    return out.select("stream_id", r6("airtime_sec").alias("airtime_sec"), r6("logo_sec").alias("logo_sec"), "keyword_pct", "promo_mentioned", r6("positive_pct").alias("positive_pct"), "n_intent", r6("earned_value").alias("earned_value"), "is_estimated", "compliance_passed")


# ---- knowledge --------------------------------------------------------------------------------

OPINION_CASES = " ".join(f"WHEN regexp_matches(lower(transcript), '{p}') THEN '{s}'" for p, s, _ in L.OPINIONS)
POLARITY_CASES = " ".join(f"WHEN regexp_matches(lower(transcript), '{p}') THEN {v}" for p, _, v in L.OPINIONS)
ATTRIBUTE_CASES = " ".join(f"WHEN contains(lower(transcript), '{w}') THEN '{a}'" for w, a in L.ATTRIBUTES)
CLAIMS = f"cl AS (SELECT stream_id, segment_id, CASE {OPINION_CASES} END AS stance, (CASE {POLARITY_CASES} END)::DOUBLE AS polarity, CASE {ATTRIBUTE_CASES} ELSE 'overall_verdict' END AS attribute FROM speech)"


@query(f"WITH $VIEWS, {CLAIMS} SELECT stream_id, segment_id, stance, polarity, 'has_' || attribute AS predicate FROM cl WHERE stance IS NOT NULL")
def claims(spark, d):
    return knowledge.claims(V.speech(spark, d), ["stream_id", "segment_id"]).select("stream_id", "segment_id", "stance", "polarity", "predicate")


@query(f"""WITH $VIEWS, {CLAIMS} SELECT stream_id, round(avg(polarity), 9) AS polarity, count(*) AS claims_count, count(DISTINCT attribute)::INT AS n_attributes,
CASE WHEN round(avg(polarity), 9) >= 0.35 THEN 'APPROVAL' WHEN round(avg(polarity), 9) <= -0.35 THEN 'DISAPPROVAL' ELSE 'NEUTRAL' END AS overall_stance FROM cl WHERE stance IS NOT NULL GROUP BY stream_id""")
def belief_synthesis(spark, d):
    found = knowledge.claims(V.speech(spark, d), ["stream_id", "segment_id"]).withColumn("subject_entity", F.lit("all"))
    out = knowledge.beliefs(found, ["stream_id"])
    return out.select("stream_id", r9("aggregate_polarity").alias("polarity"), "claims_count", F.size("sub_attributes").alias("n_attributes"), knowledge.stance_of(F.round("aggregate_polarity", 9)).alias("overall_stance"))


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '{L.LEAK_CARD}', 0) AS card, regexp_extract(text, '{L.LEAK_EMAIL}', 0) AS mail, regexp_extract(text, '{L.LEAK_IP}', 0) AS ip FROM documents)
SELECT doc_id, 'card' AS kind, card[1:4] || ' **** **** ' || card[-4:] AS value, 'critical' AS severity FROM t WHERE card <> '' AND replace(replace(replace(card, ' ', ''), '-', ''), card[1], '') <> ''
UNION ALL SELECT doc_id, 'email', mail, 'warning' FROM t WHERE mail <> ''
UNION ALL SELECT doc_id, 'token', '', 'critical' FROM t WHERE regexp_matches(text, '{L.LEAK_TOKEN}')
UNION ALL SELECT doc_id, 'ip', ip, 'warning' FROM t WHERE ip <> '' AND NOT prefix(ip, '127.') AND ip <> '0.0.0.0'""")
def leak_scan(spark, d):
    return knowledge.leaks(table(spark, d, "documents"), ["doc_id"], "text")


@query("""WITH s AS (SELECT doc_id AS claim_id, lower(text) AS t FROM documents),
c AS (SELECT claim_id, """ + ", ".join(f"({' OR '.join(f'''contains(t, '{w}')''' for w in words)})::INT AS {n}" for n, words in (("a", L.CONTRADICTION), ("o", L.OUTDATED), ("f", L.CONFIRMATION))) + """ FROM s)
SELECT claim_id, a::BIGINT AS n_against, o::BIGINT AS n_outdated, f::BIGINT AS n_for, CASE WHEN a > 0 THEN 'CONTRADICTED' WHEN o > 0 THEN 'OUTDATED' WHEN f > 0 THEN 'VERIFIED_TRUE' ELSE 'UNSUBSTANTIATED' END AS verdict FROM c""")
def claim_grounding(spark, d):
    return knowledge.grounded(table(spark, d, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("snippet")))


@query()
def entity_counts(spark, d):
    said = V.chat(spark, d).groupBy("content").agg(F.count(F.lit(1)).alias("times"))  # equal messages are looked at once
    said = said.select(F.concat("content", F.lit(" lol patch")).alias("text"), F.lit("chat").alias("source"), "times")
    rows = table(spark, d, "documents").select("text", "source", F.lit(1).cast("long").alias("times")).unionByName(said)
    return knowledge.entity_counts(rows, "text", "source", {"chat": 1, "src0": 2}, "times").select("entity", "category", "weighted", "n_texts")


@query(f"""WITH $VIEWS, {CLAIMS}, cand AS (SELECT event_id AS candidate_id, user_id % 8 AS stream_id, t AS lo, t + 60 AS hi FROM ev WHERE event_type = 'purchase'),
h AS (SELECT stream_id, timestamp_offset AS f, timestamp_offset AS u, contains(content, 'trash') AS x, contains(content, 'code') AS y FROM chat UNION ALL SELECT stream_id, start_sec, end_sec, contains(lower(transcript), 'trash'), contains(lower(transcript), 'code') FROM speech),
c AS (SELECT cl.stream_id, start_sec AS t FROM cl JOIN speech USING (stream_id, segment_id) WHERE stance = 'DISAPPROVAL'),
j AS (SELECT candidate_id, coalesce(bool_or(x), false) AS x, coalesce(bool_or(y), false) AS y FROM cand LEFT JOIN h ON h.stream_id = cand.stream_id AND (h.x OR h.y) AND h.f <= hi AND h.u >= lo GROUP BY candidate_id),
k AS (SELECT DISTINCT candidate_id FROM cand JOIN c ON c.stream_id = cand.stream_id AND c.t BETWEEN lo AND hi)
SELECT candidate_id, (x::INT + y::INT) AS n_terms, round(least(1.0, (x::INT + y::INT) * 0.35::DOUBLE), 6) AS toxicity_score, CASE WHEN x AND y THEN 'REJECTED' WHEN x OR y OR k.candidate_id IS NOT NULL THEN 'FLAGGED' ELSE 'PASSED' END AS audit_status FROM j LEFT JOIN k USING (candidate_id)""")
def policy_audit(spark, d):
    """Every purchase as a candidate, against chat, speech and the claims that disapprove (as debunked ones)."""
    e = V.events(spark, d).where("event_type = 'purchase'")
    cand = e.select(F.col("event_id").alias("candidate_id"), (F.col("user_id") % 8).alias("stream_id"), F.col("t").alias("start_sec"), (F.col("t") + 60).alias("end_sec"))
    texts = V.chat(spark, d).select("stream_id", F.col("timestamp_offset").alias("t"), F.col("content").alias("text"))
    said = V.speech(spark, d)
    status = F.when(F.col("stance") == "DISAPPROVAL", "DEBUNKED").otherwise("VERIFIED_TRUE")
    checked = knowledge.claims(said, ["stream_id", "start_sec"]).select("stream_id", F.col("start_sec").alias("t"), status.alias("verification_status"))
    out = knowledge.policy_audit(cand, texts, ["stream_id"], ["trash", "code"], said, checked, HOUR)
    return out.select("candidate_id", F.size("flagged_terms").alias("n_terms"), r6("toxicity_score").alias("toxicity_score"), "audit_status")


# ---- search -----------------------------------------------------------------------------------

TERMS = ["the", "of", "and", "the"]
TOKENS = "tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)"


@query(f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY term")
def term_stats(spark, d):
    return search.term_stats(search.postings(table(spark, d, "documents"), "doc_id", "text"))


BM25 = f"""{TOKENS}, q(term, qn) AS (VALUES ('the', 2), ('of', 1), ('and', 1)),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT doc_id, len(w) AS dl, term, qn, len(list_filter(w, lambda x: x = term)) AS tf FROM tok CROSS JOIN q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, sum(qn * ln(1 + greatest(0, (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY doc_id HAVING sum(tf) > 0)"""


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def bm25_topk(spark, d):
    scores = search.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS).withColumn("o", F.round("score", 9))
    return search.top(scores, 20, "o", "doc_id").select("doc_id", r6("score").alias("score"))


QVEC = "(SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, {QVEC} ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    s = search.cosine_scores(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d)).withColumn("o", F.round("score", 9))
    return search.top(s, 20, "o", "vec_id").select("vec_id", r6("score").alias("score"))


@query(f"""WITH {BM25}, s AS (SELECT doc_id, score / (SELECT max(score) FROM bm) AS sp FROM bm), v AS (SELECT vec_id AS doc_id, greatest(0, list_cosine_similarity(embedding::DOUBLE[], qv)) AS de FROM embeddings, {QVEC}),
h AS (SELECT doc_id, 0.5 * coalesce(sp, 0) + 0.5 * coalesce(de, 0) AS c FROM s FULL JOIN v USING (doc_id))
SELECT doc_id, round(c, 6) AS combined_score FROM h WHERE c >= 0.1 ORDER BY round(c, 9) DESC, doc_id LIMIT 20""")
def hybrid_search(spark, d):
    dense = search.cosine_scores(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d)).withColumnRenamed("vec_id", "doc_id")
    sparse = search.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS)
    h = search.hybrid(sparse, dense, "doc_id", 0.5, 0.1, 9)
    return search.top(h, 20, "combined_score", "doc_id").select("doc_id", r6("combined_score").alias("combined_score"))


@query("""WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
n AS (SELECT label, list(m ORDER BY i) AS cv FROM c GROUP BY label),
s AS (SELECT vec_id, n.label AS centroid_id, list_cosine_similarity(embedding::DOUBLE[], cv) AS sim FROM embeddings CROSS JOIN n)
SELECT vec_id, centroid_id, round(sim, 6) AS sim, sim >= 0.75 AS is_known FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, centroid_id) AS r FROM s) WHERE r = 1""")
def label_centroid_match(spark, d):
    e = table(spark, d, "embeddings")
    out = knowledge.centroid_match(e, knowledge.centroids(e, "label", "embedding"), "vec_id", "embedding")
    return out.withColumn("sim", r6("sim"))


@query()
def hash_embeddings(spark, d):
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    e = search.embedded(docs, "chunk_id", "text")
    return e.select("chunk_id", r6(C.norm(F.col("embedding"))).alias("norm"))


@query(f"""WITH $VIEWS, ch AS (SELECT stream_id, segment_id, start_sec FROM speech),
j AS (SELECT ch.stream_id, segment_id, message_id, row_number() OVER (PARTITION BY ch.stream_id, segment_id ORDER BY timestamp_offset, message_id)::INT AS r FROM ch JOIN chat ON chat.stream_id = ch.stream_id AND timestamp_offset BETWEEN start_sec - 600 AND start_sec + 600)
SELECT stream_id, segment_id, r, message_id FROM j WHERE r <= 10""")
def chat_context(spark, d):
    return search.chat_context(V.speech(spark, d), V.chat(spark, d), ["stream_id"], "segment_id", "start_sec", 600.0)


@query()
def rag_evidence(spark, d):
    docs = table(spark, d, "documents")
    scores = search.bm25(docs, "doc_id", "text", TERMS).join(docs.select("doc_id", "text", "source", "lang"), "doc_id")
    return search.evidence(scores.withColumn("score", r6("score")), "source", "lang", "text", "score", "doc_id", {"en": 2, "fr": 1, "de": 1})


# ---- folds ------------------------------------------------------------------------------------


@query()
def greedy_nms(spark, d):
    e = V.events(spark, d).select((F.col("user_id") % 8).alias("stream_id"), "event_id", "t", "value")
    return folds.greedy_nms(e, ["stream_id"], "t", "value", "event_id", DAY)


@query()
def scene_segments(spark, d):
    k = V.keyframes(spark, d)
    out = folds.scene_segments(k, ["stream_id"], "timestamp_sec", "scene_type", "frame_index", DAY / 4)
    return out.select("stream_id", "segment_id", "frame_index", "scene_type")


@query()
def scene_chapters(spark, d):
    m = _matrix(spark, d)
    seg = folds.scene_segments(m, ["stream_id"], "start_sec", "active_scene_type", "bucket_index", DAY)
    out = fusion.chapters(seg.select("stream_id", "segment_id", "bucket_index"), m, ["stream_id"])
    return out.select("stream_id", "segment_id", "scene_type", "title", C.clock(F.col("start_sec")).alias("label"), "start_sec", "end_sec", r6("mean_velocity").alias("mean_velocity"))


THIN = f"""WITH RECURSIVE $VIEWS, o AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM ev),
r AS (SELECT user_id, event_id, t, k, t AS last, true AS kept FROM o WHERE k = 1 UNION ALL
SELECT o.user_id, o.event_id, o.t, o.k, CASE WHEN o.t - r.last >= {DAY} THEN o.t ELSE r.last END, o.t - r.last >= {DAY} FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id, round(t, 6) AS t FROM r WHERE kept"""


@query(THIN)
def thin_chapters(spark, d):
    e = V.events(spark, d).select("user_id", "event_id", "t")
    return folds.thinned(e, ["user_id"], "t", "event_id", DAY).select("user_id", "event_id", r6("t").alias("t"))


@query()
def transcript_chunks(spark, d):
    return folds.chunked(V.speech(spark, d), ["stream_id"], "start_sec", "end_sec", "transcript", 3600.0, 60.0)


@query()
def caption_lines(spark, d):
    words = V.speech(spark, d).select("stream_id", F.col("start_sec"), F.posexplode(C.words(F.col("transcript"))).alias("k", "word"))
    timed = words.select("stream_id", (F.col("start_sec") + F.col("k") * 0.4).alias("s"), (F.col("start_sec") + F.col("k") * 0.4 + 0.3).alias("e"), "word")
    return folds.caption_lines(timed, ["stream_id"], "s", "e", "word")


@query()
def meme_bursts(spark, d):
    return folds.leader_clusters(V.chat(spark, d), ["stream_id"], "timestamp_offset", "message_id", "author_name", "content", 0.65, HOUR, 3, split=C.similarity_tokens)


@query()
def brigades(spark, d):
    c = V.chat(spark, d).withColumn("tokens", C.similarity_tokens(F.col("content"))).where(F.size("tokens") >= 2)
    return folds.leader_clusters(c, ["stream_id"], "timestamp_offset", "message_id", "user_id", "tokens", 0.70, 2 * HOUR, 4)


@query()
def slang_bursts(spark, d):
    c = V.chat(spark, d).select("stream_id", "timestamp_offset", "author_name", F.explode(F.array_distinct(C.words(F.lower("content")))).alias("token"))
    w = temporal.sliding(c, F.col("timestamp_offset"), 36000.0, 18000.0).groupBy("stream_id", "token", "window_start").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author_name").alias("a"))
    return folds.ema_bursts(w, ["stream_id", "token"], "window_start", "n", "a", 10.0, 4, 3, 1.0).withColumn("z_score", r6("z_score"))


@query()
def sampling_times(spark, d):
    chat = V.chat(spark, d)
    b = temporal.z_bursts(_dense(spark, d), ["stream_id"]).select("stream_id", (F.col("bucket_index") * HOUR).alias("lo"), ((F.col("bucket_index") + 1) * HOUR).alias("hi"))
    rows = V.bounds(chat).join(b, "stream_id", "left")
    return folds.sample_times(rows, ["stream_id"], "duration", "lo", "hi", 300.0, 3000.0)


# ---- co-streams -------------------------------------------------------------------------------


def _aligned(spark, d):
    chat = V.chat(spark, d)
    offsets = spark.createDataFrame([(0, 0.0), (1, 2.5), (2, -1.0)], "channel_id long, offset_sec double")
    return costream.unified(chat, offsets, "timestamp_offset")


@query("WITH $VIEWS SELECT message_id, channel_id, round(timestamp_offset - CASE channel_id WHEN 1 THEN 2.5 WHEN 2 THEN -1.0 ELSE 0 END, 6) AS unified_ts FROM chat")
def unified_clock(spark, d):
    return _aligned(spark, d).select("message_id", "channel_id", r6("unified_ts").alias("unified_ts"))


CROSS = ", ".join(f"('{k}', {v})" for k, v in L.CROSS_POLARITY.items())


@query(f"""WITH $VIEWS, lex(token, p) AS (VALUES {CROSS}), al AS (SELECT *, timestamp_offset - CASE channel_id WHEN 1 THEN 2.5 WHEN 2 THEN -1.0 ELSE 0 END AS u FROM chat),
s AS (SELECT message_id, coalesce(avg(p), 0) AS s FROM (SELECT message_id, unnest(string_split(lower(content), ' ')) AS token FROM chat) LEFT JOIN lex USING (token) GROUP BY message_id),
b AS (SELECT stream_id, platform, floor((u - min(u) OVER (PARTITION BY stream_id)) / {DAY})::BIGINT AS bucket_index, s FROM al JOIN s USING (message_id)),
p AS (SELECT stream_id, bucket_index, platform, avg(s) AS m, count(*) AS n FROM b GROUP BY ALL)
SELECT stream_id, bucket_index, sum(n)::BIGINT AS n_messages, count(*) AS n_platforms, round(max(m) - min(m), 9) AS spread, round(greatest(0, least(1, 1 - (max(m) - min(m)) / 2)), 9) AS agreement FROM p GROUP BY ALL HAVING sum(n) >= 3""")
def sentiment_timeline(spark, d):
    t = costream.sentiment_timeline(_aligned(spark, d), ["stream_id"], width=DAY)
    return t.select("stream_id", "bucket_index", "n_messages", "n_platforms", r9("spread").alias("spread"), r9("agreement").alias("agreement"))


@query()
def agreement_summary(spark, d):
    t = costream.sentiment_timeline(_aligned(spark, d), ["stream_id"], width=DAY)
    return costream.agreement_summary(t, ["stream_id"]).withColumn("mean_agreement", r6("mean_agreement"))


@query(f"""WITH $VIEWS, al AS (SELECT *, timestamp_offset - CASE channel_id WHEN 1 THEN 2.5 WHEN 2 THEN -1.0 ELSE 0 END AS u FROM chat WHERE contains(content, 'KEKW')),
l AS (SELECT *, lead(u, 2) OVER (PARTITION BY channel_id ORDER BY u, message_id) AS k FROM al), a AS (SELECT channel_id, coalesce(min(u) FILTER (k - u <= {HOUR}), min(u)) AS arrival FROM l GROUP BY channel_id)
SELECT 'kekw' AS token, channel_id, round(arrival, 6) AS arrival, round(arrival - min(arrival) OVER (), 6) AS delay_sec FROM a""")
def meme_cascade(spark, d):
    out = costream.cascade(_aligned(spark, d), "kekw", k=3, within=HOUR)
    return out.select("token", "channel_id", r6("arrival").alias("arrival"), r6("delay_sec").alias("delay_sec"))


@query(f"""WITH $VIEWS, r AS (SELECT user_id % 8 AS k, event_id AS r_id, t AS r_ts FROM ev WHERE event_type = 'error'), p AS (SELECT user_id % 8 AS k, event_id AS n_id, t AS n_ts FROM ev WHERE event_type = 'signup'),
n AS (SELECT k, n_ts - r_ts AS d FROM (SELECT r.k, r_id, r_ts, n_ts, row_number() OVER (PARTITION BY r.k, r_id ORDER BY abs(n_ts - r_ts), n_ts, n_id) AS i FROM r JOIN p ON p.k = r.k AND abs(n_ts - r_ts) <= {HOUR}) WHERE i = 1),
m AS (SELECT k, median(d) AS offset_sec, count(*) AS n_pairs FROM n GROUP BY k)
SELECT k, round(offset_sec, 6) AS offset_sec, round(median(abs(d - offset_sec)), 6) AS mad, n_pairs FROM n JOIN m USING (k) GROUP BY k, offset_sec, n_pairs""")
def trigger_offset(spark, d):
    e = V.events(spark, d).withColumn("k", F.col("user_id") % 8)
    out = costream.trigger_offset(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), ["k"], "t", "event_id", HOUR)
    return out.select("k", r6("offset_sec").alias("offset_sec"), r6("mad").alias("mad"), "n_pairs")


@query()
def correlation_offset(spark, d):
    e = V.events(spark, d)
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    h = e.groupBy((F.col("user_id") % 8).alias("k"), F.floor(F.col("t") / HOUR).alias("bin")).agg(n("view").alias("a"), n("error").alias("b"))
    out = costream.correlation_offset(h, ["k"], 12, HOUR)
    return out.select("k", "offset_sec", r6("confidence").alias("confidence"))


@query()
def multi_angle_candidates(spark, d):
    a = _aligned(spark, d)
    t = costream.sentiment_timeline(a, ["stream_id"], width=DAY).withColumn("timestamp_sec", F.col("bucket_index") * DAY)
    out = costream.multi_angle(t, a, ["stream_id"], HOUR)
    return out.select("stream_id", "bucket_index", "n_messages", r6("virality_score").alias("virality_score"))


# ---- clips ------------------------------------------------------------------------------------


# ---- stores and catalogues --------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, c_acctbal DESC, o_orderkey LIMIT 50")
def catalog_queue(spark, d):
    t = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    out = store.queue(table(spark, d, "orders"), t, "o_custkey", F.col("o_orderstatus") == "O", [F.col("o_orderpriority"), F.desc("c_acctbal"), F.col("o_orderkey")], 50)
    return out.select("o_orderkey", "o_custkey", "c_name", "o_orderpriority")


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_targets FROM orders GROUP BY o_orderstatus")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_targets"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_new(spark, d):
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.unknown(table(spark, d, "customer"), known, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r <= 1 ORDER BY o_orderpriority, o_orderkey LIMIT 30")
def admission_limit(spark, d):
    q = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return store.admitted(q, "o_custkey", [F.col("o_orderpriority"), F.col("o_orderkey")], 1, 30).select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '3' AND event_type = 'click' ORDER BY ts, event_id LIMIT 50 OFFSET 5")
def json_event_filter(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    return store.json_filter(e, "props", {"$.k": "3"}, ["ts", "event_id"], 50, 5).select("event_id", "user_id", "event_type")


@query("""WITH b AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 7 = 0) SELECT o_orderkey, o_custkey, o_orderstatus FROM b UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0""")
def upsert_latest(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    batch = t.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X"))
    return store.upsert(t, batch, ["o_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) - l_quantity AS freed FROM lineitem) WHERE freed < 500""")
def prune_plan(spark, d):
    out = store.prune_plan(table(spark, d, "lineitem"), "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 500)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""WITH a AS (SELECT l_returnflag || l_linestatus AS k, avg(l_quantity) AS v FROM lineitem WHERE l_shipdate < DATE '1996-01-01' GROUP BY 1), b AS (SELECT l_returnflag || l_linestatus AS k, avg(l_quantity) AS v FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' GROUP BY 1)
SELECT k, round(coalesce(b.v, 0), 6) AS now, round(coalesce(a.v, 0), 6) AS was, round(CASE WHEN a.v > 0 THEN (coalesce(b.v, 0) - a.v) / a.v END, 6) AS change,
CASE WHEN a.v IS NULL THEN 'NEW' WHEN (coalesce(b.v, 0) - a.v) / a.v > 0.4 THEN 'CRITICAL' WHEN (coalesce(b.v, 0) - a.v) / a.v > 0.25 THEN 'WARNING' ELSE 'OK' END AS level FROM b FULL JOIN a USING (k)""")
def run_comparison(spark, d):
    l = table(spark, d, "lineitem").withColumn("k", F.concat("l_returnflag", "l_linestatus"))
    run = lambda cond: l.where(cond).groupBy("k").agg(F.avg("l_quantity").alias("v"))
    out = store.compare_runs(run("l_shipdate >= DATE '1995-01-01'"), run("l_shipdate < DATE '1996-01-01'"), "k", "v")
    return out.select("k", r6("now").alias("now"), r6("was").alias("was"), r6("change").alias("change"), "level")


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS is_valid FROM events")
def schema_validation(spark, d):
    return store.validated(table(spark, d, "events"), "props", "k bigint", ["k"]).select("event_id", "is_valid")


@query("""SELECT user_id AS stream_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def stream_summary(spark, d):
    n = lambda k: F.sum((F.col("event_type") == k).cast("long")).alias(f"n_{k}")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("stream_id")).agg(F.count(F.lit(1)).alias("n_events"), n("click"), n("error"), n("purchase"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH s AS (SELECT event_type AS term, max(ts) AS last_seen, 0.5 + 0.04 * (count(*) % 10) AS confidence FROM events GROUP BY event_type)
SELECT term, round(confidence * pow(2, -greatest(0, epoch(TIMESTAMP '2024-02-10' - date_trunc('second', last_seen)) / 86400.0) / 14), 6) AS decayed_confidence FROM s WHERE confidence * pow(2, -greatest(0, epoch(TIMESTAMP '2024-02-10' - date_trunc('second', last_seen)) / 86400.0) / 14) >= 0.2""")
def lexicon_decay(spark, d):
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("term")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen"), (0.5 + 0.04 * (F.count(F.lit(1)) % 10)).alias("confidence"))
    return knowledge.decayed(s, F.lit("2024-02-10").cast("timestamp")).select("term", r6("decayed_confidence").alias("decayed_confidence"))


# ---- streaming twins --------------------------------------------------------------------------


def _event_stream(spark, d):
    """The events as a stream that is read file by file."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, time_bucket(INTERVAL 1 day, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    from vodlens.streaming import live

    out = live.run_available(live.tumbling(_event_stream(spark, d), ["event_type"], "ts", "1 day", "60 days"), "tumbling", "complete")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_dedupe(spark, d):
    from vodlens.streaming import live

    e = _event_stream(spark, d)
    out = live.run_available(live.distinct_messages(e.unionByName(e), "event_id", "ts", "60 days").select("event_id"), "dedupe")
    return out.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def stream_ring(spark, d):
    from vodlens.streaming import live

    out = live.run_available(live.ring(_event_stream(spark, d), "user_id", "ts", "event_id", 5), "ring", "update")
    return out.select("user_id", "event_id")


@cache
def _complete() -> None:
    from vodlens.plans import deep, feeds, making, more, oracles, wider  # noqa: F401  all but making register their queries

    ORACLES.update(oracles.ORACLES)
    making.register()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _complete()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _complete()
    return dict(ORACLES)
