"""Queries of the stored parts: live logs, catalog databases, the vector index, block scans and folds, media, state tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vodlens.operators import vector_index
from vodlens.plans import views as V
from vodlens.plans.catalog import query, r6
from vodlens.plans.session import shared_folder
from vodlens.plans.views import table


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH $VIEWS SELECT message_id::VARCHAR AS message_id, round(timestamp_offset, 3) AS timestamp_offset, author_name, content, 'ch' || channel_id AS channel,
row_number() OVER (PARTITION BY channel_id ORDER BY timestamp_offset, message_id) - 1 AS place FROM chat""")
def live_log(spark, d):
    """Chat recorded as IRC lines into a log of segments and read back as a stream, each channel in its own order."""
    from pyspark.sql import Window

    from vodlens.sources import chat, connectors
    from vodlens.streaming import live

    rows = V.chat(spark, d)
    tags = F.concat(F.lit("@id="), F.col("message_id").cast("string"), F.lit(";tmi-sent-ts="), F.round(F.col("timestamp_offset") * 1000).cast("long").cast("string"), F.lit(";display-name="), F.col("author_name"))
    line = F.concat(tags, F.lit(" :u!u@u PRIVMSG #ch"), F.col("channel_id").cast("string"), F.lit(" :"), F.col("content"))
    place = F.row_number().over(Window.partitionBy("channel_id").orderBy("timestamp_offset", "message_id")).cast("long") - 1
    log = _folder(spark, "live-log")
    connectors.record(rows.select(F.concat(F.lit("ch"), "channel_id").alias("channel"), place.alias("place"), F.timestamp_seconds("timestamp_offset").alias("received_at"), line.alias("value")), log)
    lines = live.run_available(connectors.live_lines(spark, log), "live-log")
    parsed = chat.irc(lines.select("value"))
    found = chat.twitch(parsed).select("message_id", F.round("timestamp_offset", 3).alias("timestamp_offset"), "author_name", "content")
    ids = lines.select(F.regexp_extract("value", "^@id=([^;]*)", 1).alias("message_id"), "channel", "place")
    return found.join(ids, "message_id")


@query("""SELECT 'o' || o_orderkey AS vod_id, 'c' || o_custkey AS streamer_id, round(o_totalprice / 10, 6) AS duration_sec, CASE o_orderstatus WHEN 'F' THEN 'ANALYZED' WHEN 'O' THEN 'QUEUED' ELSE 'DISCOVERED' END AS status,
epoch(o_orderdate)::BIGINT AS published, o_orderpriority AS priority, [o_orderpriority, o_orderstatus][1] AS first_tag FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000""")
def catalog_scan(spark, d):
    """Orders as recordings in a folder of SQLite shards, read back typed, with the filters pushed to the databases."""
    from vodlens.sources import catalogdb

    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ANALYZED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("no such state")
    rows = o.select(
        F.concat(F.lit("o"), "o_orderkey").alias("vod_id"), F.concat(F.lit("c"), "o_custkey").alias("streamer_id"), (F.col("o_totalprice") / 10).alias("duration_sec"), status.alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"), F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("tags"), F.to_json(F.array("o_orderpriority", "o_orderstatus"))).alias("raw_metadata"),
    )
    path = _folder(spark, "catalog")
    catalogdb.write_tables(rows, path, "harvested_vods")
    back = catalogdb.read_table(spark, path, "harvested_vods", catalogdb.VODS).where(F.col("status").isin("ANALYZED", "QUEUED") & (F.col("duration_sec") > 10000.0))
    tags = F.from_json(F.try_element_at("raw_metadata", F.lit("tags")), "array<string>")
    return back.select("vod_id", "streamer_id", r6("duration_sec").alias("duration_sec"), "status", F.unix_seconds("published_at").alias("published"), F.try_element_at("raw_metadata", F.lit("priority")).alias("priority"), F.get(tags, F.lit(0)).alias("first_tag"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id AS item, round(list_cosine_similarity(q.e, c.e), 9) AS s FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, item, round(s, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item)::INT AS rank FROM p) WHERE rank <= 10""")
def vector_lists(spark, d):
    """Similar vectors through stored inverted lists: probed lists first, then those that may still hold a better one."""
    e = table(spark, d, "embeddings")
    index = vector_index.build(e, "vec_id", "embedding", _folder(spark, "vectors"))
    out = vector_index.search(index, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, probes=4, exact=True, not_self=True)
    return out.withColumn("sim", r6("sim"))


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT label, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
r AS (SELECT label, k, x AS c FROM o WHERE k = 1 UNION ALL SELECT label, k, list_transform(t, lambda z: z / CASE WHEN list_inner_product(t, t) > 0 THEN sqrt(list_inner_product(t, t)) ELSE 1 END) FROM
(SELECT o.label, o.k, list_transform(list_zip(r.c, o.x), lambda z: ((o.k - 1) * z[1] + z[2]) / o.k) AS t FROM r JOIN o ON o.label = r.label AND o.k = r.k + 1))
SELECT label, k AS sample_count, round(c[1], 6) AS c_first, round(c[64], 6) AS c_last, round(list_sum(list_transform(c, lambda z: abs(z))), 6) AS c_size FROM r QUALIFY k = max(k) OVER (PARTITION BY label)""")
def voiceprints(spark, d):
    """Each label's embeddings folded in order into an enrolled centroid, over blocks."""
    from vodlens.operators import enrolment

    out = enrolment.enrol(table(spark, d, "embeddings"), "label", ["vec_id"], "embedding", 100)
    size = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + F.abs(x))
    return out.select("label", "sample_count", r6(F.get("centroid", F.lit(0))).alias("c_first"), r6(F.get("centroid", F.lit(63))).alias("c_last"), r6(size).alias("c_size"))


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n, user_id % 64 AS channel FROM events),
subs AS (SELECT channel, user_id, n, event_id % 3 AS kind FROM e WHERE event_type = 'signup'), posts AS (SELECT channel, n, event_id, event_type FROM e WHERE event_type IN ('view', 'purchase')),
pairs AS (SELECT p.*, c.user_id FROM posts p JOIN (SELECT DISTINCT channel, user_id FROM subs) c USING (channel)),
fit AS (SELECT p.user_id, p.event_id, row_number() OVER (PARTITION BY p.user_id ORDER BY p.n) AS r FROM pairs p ASOF JOIN subs s ON p.user_id = s.user_id AND p.n >= s.n WHERE s.kind = 2 OR (s.kind = 0) = (p.event_type = 'view'))
SELECT 'u' || user_id AS client, event_id AS item, CASE WHEN r <= 40 THEN 'QUEUED' ELSE 'DROPPED' END AS what FROM fit""")
def live_broadcast(spark, d):
    """Clients join and change their topics while events come: what each client's queue takes and what it drops."""
    from vodlens.plans.catalog import _event_stream
    from vodlens.streaming import broadcast, live

    e = _event_stream(spark, d)
    is_join = F.col("event_type") == "signup"
    kind = F.col("event_id") % 3
    topics = F.when(is_join, F.when(kind == 0, F.array(F.lit("view"))).when(kind == 1, F.array(F.lit("purchase"))).otherwise(F.array(F.lit("*"))))
    ops = e.where(F.col("event_type").isin("signup", "view", "purchase")).select(
        (F.col("user_id") % 64).cast("string").alias("channel"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.when(is_join, "join").otherwise("event").alias("op"),
        F.when(is_join, F.concat(F.lit("u"), "user_id")).alias("client"), topics.alias("topics"), "event_type", F.col("event_id").alias("item"), F.lit(0).alias("count"),
    )
    with broadcast.state_store(spark):
        out = live.run_available(broadcast.broadcast(ops, shards=2, capacity=40, idle_sec=1e9, delay="60 days"), "broadcast")
    return out.where(F.col("what").isin("QUEUED", "DROPPED")).select("client", "item", "what")


PCM = "floor(greatest(-1, least(1, x::DOUBLE)) * 32767 + 0.5) / 32768"


@query(f"""WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, list_transform(embedding, lambda x: {PCM}) AS p FROM embeddings),
s AS (SELECT label, n, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i, unnest(list_concat([NULL], p[1:63])) AS before FROM v),
f AS (SELECT label, n, sqrt(avg(x * x)) AS rms, avg(((x < 0) <> (before < 0))::INT) AS zcr FROM s GROUP BY ALL),
d AS (SELECT label, n, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2)) AS m FROM s, generate_series(0, 32) g(k) GROUP BY ALL),
c AS (SELECT label, n, sum(k * m) / (sum(m) + 1e-8) AS centroid FROM d GROUP BY ALL)
SELECT label, n AS "window", round(rms, 6) AS rms, round(zcr, 6) AS zero_crossing_rate, round(centroid, 6) AS spectral_centroid, CASE WHEN rms >= 0.9 * avg(rms) OVER (PARTITION BY label) THEN 'STREAMER' ELSE 'EXTERNAL_VIDEO' END AS speaker_label FROM f JOIN c USING (label, n)""")
def audio_profile(spark, d):
    """Embeddings as PCM files, one per label, read back window by window: loudness, crossings, spectrum and who is near the microphone."""
    from vodlens.operators import sound
    from vodlens.sources import media

    folder = _folder(spark, "audio")
    done = media.write_wav(table(spark, d, "embeddings"), "label", ["vec_id"], "embedding", folder, 64)
    done.write.format("noop").mode("overwrite").save()
    found = media.acoustic_profile(spark, folder, window_sec=1.0).withColumn("label", F.regexp_extract("path", r"/([^/]*)\.wav$", 1).cast("int"))
    out = sound.near_microphone(found, ["label"])
    return out.select("label", "window", r6("rms").alias("rms"), r6("zero_crossing_rate").alias("zero_crossing_rate"), r6("spectral_centroid").alias("spectral_centroid"), "speaker_label")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, unnest([0, 16, 32]) AS f FROM embeddings), s AS (SELECT vec_id, f // 16 AS frame, x[f + 1:f + 32] AS p FROM v),
u AS (SELECT vec_id, frame, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i, unnest(list_concat([NULL], p[1:31])) AS before FROM s),
m AS (SELECT vec_id, frame, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 32)), 2) + pow(sum(x * sin(2 * pi() * k * i / 32)), 2)) AS m FROM u, generate_series(0, 16) g(k) GROUP BY ALL),
c AS (SELECT vec_id, frame, sum(k * 500 * m) / (sum(m) + 1e-8) AS c FROM m GROUP BY ALL)
SELECT vec_id AS item, frame, round(sqrt(avg(x * x)), 6) AS rms, round(avg(((x < 0) <> (before < 0))::INT), 6) AS zero_crossing_rate, round(any_value(c), 4) AS spectral_centroid FROM u JOIN c USING (vec_id, frame) GROUP BY vec_id, frame""")
def audio_frames(spark, d):
    """Features of overlapping frames of 32 samples within each embedding taken as samples."""
    from vodlens.operators import sound

    out = sound.frame_features(table(spark, d, "embeddings"), "vec_id", "embedding", 16_000, 32, 16)
    return out.select("item", "frame", r6("rms").alias("rms"), r6("zero_crossing_rate").alias("zero_crossing_rate"), F.round("spectral_centroid", 4).alias("spectral_centroid"))


@query("""WITH $VIEWS, o AS (SELECT event_id, user_id, t, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END::DOUBLE AS v FROM ev),
a AS (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM o)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (v * p < 0) AS reversals, round(CASE WHEN count(*) < 2 THEN 0 ELSE least(1.0, coalesce(sum(abs(v - p)), 0) / (2.0 * (count(*) - 1))) END, 6) AS volatility FROM a GROUP BY user_id""")
def stance_history(spark, d):
    """Stance observations added to a state table in overlapping batches, and what its last version says."""
    from vodlens.operators import islands
    from vodlens.plans.catalog import STANCE, WEEK
    from vodlens.sources import state

    kept = state.StateTable(spark, _folder(spark, "stances"))
    rows = V.events(spark, d).select(F.col("event_id").alias("observation_id"), "user_id", "t", F.expr(STANCE).cast("double").alias("v"))
    for k in range(3):
        state.add_observations(kept, rows.where(F.col("observation_id") % 3 <= k))
    steps = islands.lagged(kept.read(), ["user_id"], ["t", "observation_id"], WEEK, p="v")
    n, step = F.count(F.lit(1)), F.abs(F.col("v") - F.col("p"))
    volatility = F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.sum(step), F.lit(0.0)) / (2.0 * (n - 1))))
    return steps.groupBy("user_id").agg(n.alias("n_rows"), F.count_if(F.col("v") * F.col("p") < 0).alias("reversals"), r6(volatility).alias("volatility"))


@query("""WITH $VIEWS, c AS (SELECT event_id, user_id % 8 AS stream_id, t AS lo, t + 600 AS hi FROM ev WHERE event_type = 'signup')
SELECT c.stream_id, event_id, segment_id, round(least(hi, end_sec) - greatest(lo, start_sec), 6) AS shared_sec FROM c JOIN speech s ON s.stream_id = c.stream_id AND NOT (hi < start_sec OR lo > end_sec)""")
def overlap_pairs(spark, d):
    """Ten minutes after each signup against the segments that they meet, ends included."""
    from vodlens.operators import temporal

    c = V.events(spark, d).where("event_type = 'signup'").select("event_id", (F.col("user_id") % 8).alias("stream_id"), F.col("t").alias("lo"), (F.col("t") + 600).alias("hi"))
    s = V.speech(spark, d).select("stream_id", "segment_id", "start_sec", "end_sec")
    out = temporal.overlap_join(c, s, ["stream_id"], ("lo", "hi"), ("start_sec", "end_sec"), 3600.0)
    return out.select("stream_id", "event_id", "segment_id", r6(F.least("hi", "end_sec") - F.greatest("lo", "start_sec")).alias("shared_sec"))


def _register_inverted() -> None:
    from vodlens.plans.catalog import BM25, TERMS

    @query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 100")
    def inverted_search(spark, d):
        """BM25 from a stored inverted index: only the query's terms are read."""
        from vodlens.operators import inverted, search

        index = inverted.build(table(spark, d, "documents"), "doc_id", "text", _folder(spark, "inverted"))
        s = index.bm25(TERMS).withColumn("o", F.round("score", 9))
        return search.top(s, 100, "o", "item").select(F.col("item").alias("doc_id"), r6("score").alias("score"))


_register_inverted()
