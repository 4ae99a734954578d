"""Named queries of production, the chunk index, registries and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.functions import lexicons as L
from vodlens.operators import clips, costream, folds, index, knowledge, media, production, registry, search, temporal
from vodlens.plans import views as V
from vodlens.plans.catalog import CLAIMS, CROSS, DAY, DENSE, HOUR, QVEC, _aligned, _dense, _event_stream, _matrix, _query_vector, query, r6, r9
from vodlens.plans.session import checkpointed
from vodlens.plans.views import table

# ---- shorts -------------------------------------------------------------------------------------


def _picked(spark, d):
    """Anchors from highlights and bursts, thinned, as clips of 40 seconds that snap to speech."""
    e = V.events(spark, d).select((F.col("user_id") % 8).alias("stream_id"), F.col("event_id").cast("string").alias("item"), F.col("t").alias("peak_sec"), F.col("value"))
    best = e.groupBy("stream_id").agg(F.max("value").alias("best"))
    h = e.join(best, "stream_id").withColumn("score", F.round(F.col("value") / F.col("best"), 9)).drop("value", "best")
    b = temporal.z_bursts(_dense(spark, d), ["stream_id"]).select("stream_id", F.col("bucket_index").cast("string").alias("item"), (F.col("bucket_index") * HOUR).alias("peak_sec"), F.round("z_score", 9).alias("z_score"))
    picked = clips.select_candidates(clips.anchors(h, b, ["stream_id"]), ["stream_id"], 6 * HOUR, 20)
    c = picked.select("stream_id", "anchor_id", "score", F.greatest(F.lit(0.0), F.col("peak_sec") - 20).alias("start_sec"), (F.col("peak_sec") + 20).alias("end_sec"))
    # Few rows that everything below joins again and again: worked out once.
    return checkpointed(clips.snap(checkpointed(c), V.speech(spark, d), ["stream_id"], "anchor_id").drop("start_sec", "end_sec"))


def _candidates(spark, d):
    """Clips with their chat evidence, hook, arc and emotion."""
    key = ["stream_id"]
    c = _picked(spark, d)
    evidence = production.chat_evidence(c, V.chat(spark, d), key, "anchor_id", "clip_start", "clip_end")
    c = production.hooks(c.join(evidence, [*key, "anchor_id"]), V.speech(spark, d), key, "anchor_id", "clip_start", "clip_end", HOUR)
    m = _matrix(spark, d).select("stream_id", ((F.col("start_sec") + F.col("end_sec")) / 2).alias("mid"), F.coalesce(F.when(F.col("agreement_score") != 0, F.col("agreement_score")), F.lit(0.5)).alias("agreed"))
    spans = c.select(*key, "anchor_id", (F.col("clip_start") - HOUR).alias("a_low"), (F.col("clip_end") + HOUR).alias("a_high"))
    agreed = temporal.range_join(m, spans, key, "mid", "a_low", "a_high", 2 * HOUR).groupBy(*key, "anchor_id").agg(F.round(F.avg("agreed"), 9).alias("agreed"))
    a = clips.arc(F.col("score"), F.col("z"), F.col("agreed"))
    return checkpointed(c.join(agreed, [*key, "anchor_id"], "left").withColumn("arc", a).select("*", "arc.narrative_arc", "arc.primary_emotion").drop("arc"))


def strip(c: str) -> str:
    return f"lower(trim({c}, '!?,.:;\"''()'))"


def candidates_sql() -> str:
    from vodlens.plans.oracles import BURSTS, MATRIX, greedy, words

    return f"""{MATRIX}, {BURSTS}, an AS (SELECT stream_id, 'h' || event_id AS item, t, sc AS score FROM (SELECT user_id % 8 AS stream_id, event_id, t, round(value / max(value) OVER (PARTITION BY user_id % 8), 9) AS sc FROM ev) WHERE sc >= 0.65
  UNION ALL SELECT stream_id, 'b' || bucket_index, bucket_index * {HOUR}, least(1.0, 0.5 + round(z, 9) / 10) FROM zb WHERE round(z, 9) >= 2.5), {greedy('an', 6 * HOUR, 20)},
pk AS (SELECT stream_id, item AS anchor_id, score, greatest(0.0, t - 20) AS s0, t + 20 AS e0 FROM r JOIN o USING (stream_id, k) WHERE pick IS NOT NULL),
sn AS (SELECT p.*, (SELECT arg_min(s.start_sec, segment_id) FROM speech s WHERE s.stream_id = p.stream_id AND s.start_sec BETWEEN s0 - 3 AND s0 + 3) AS ss, (SELECT arg_max(s.end_sec, segment_id) FROM speech s WHERE s.stream_id = p.stream_id AND s.end_sec BETWEEN e0 - 4 AND e0 + 4 AND s.end_sec > s0 + 15) AS se FROM pk p),
cp AS MATERIALIZED (SELECT stream_id, anchor_id, score, greatest(0.0, coalesce(ss, s0)) AS clip_start, greatest(0.0, coalesce(ss, s0)) + least(60.0, greatest(15.0, coalesce(se, e0) - greatest(0.0, coalesce(ss, s0)))) AS clip_end FROM sn),
al2 AS (SELECT stream_id, count(*) AS n_all, greatest(1.0, max(timestamp_offset) - min(timestamp_offset)) AS span FROM chat GROUP BY 1),
nr AS MATERIALIZED (SELECT c.stream_id, anchor_id, message_id, timestamp_offset, content FROM cp c JOIN chat USING (stream_id) WHERE timestamp_offset BETWEEN clip_start AND clip_end), ct AS (SELECT stream_id, anchor_id, count(*) AS n_in FROM nr GROUP BY ALL),
wr AS (SELECT stream_id, anchor_id, {strip('w')} AS w, timestamp_offset AS a, message_id AS b, i FROM (SELECT stream_id, anchor_id, timestamp_offset, message_id, unnest({words('content')}) AS w, generate_subscripts({words('content')}, 1) AS i FROM nr)),
wc AS (SELECT *, row_number() OVER (PARTITION BY stream_id, anchor_id ORDER BY n DESC, first) AS g FROM (SELECT stream_id, anchor_id, w, count(*) AS n, min(struct_pack(a := a, b := b, i := i)) AS first FROM wr WHERE length(w) >= 3 AND NOT prefix(w, 'http') GROUP BY ALL) WHERE n >= 2),
dm AS (SELECT stream_id, anchor_id, list(w ORDER BY g) AS dominant FROM wc WHERE g <= 5 GROUP BY ALL),
hk AS (SELECT stream_id, anchor_id, list(trim(transcript) ORDER BY start_sec, segment_id) AS lines FROM cp JOIN speech s USING (stream_id) WHERE s.start_sec <= clip_end AND s.end_sec >= clip_start GROUP BY ALL),
ag AS (SELECT c.stream_id, anchor_id, round(avg(coalesce(nullif(agreement_score, 0), 0.5)), 9) AS agreed FROM cp c JOIN mat m ON m.stream_id = c.stream_id AND (start_sec + end_sec) / 2 BETWEEN clip_start - {HOUR} AND clip_end + {HOUR} GROUP BY ALL),
zz AS (SELECT cp.*, least(10.0, greatest(0.0, (coalesce(n_in, 0) / greatest(1.0, clip_end - clip_start) - n_all / span) / greatest(0.5, 0.5 * n_all / span))) AS z, coalesce(dominant, []) AS dominant, coalesce(lines, []) AS lines, agreed FROM cp JOIN al2 USING (stream_id) LEFT JOIN ct USING (stream_id, anchor_id) LEFT JOIN dm USING (stream_id, anchor_id) LEFT JOIN hk USING (stream_id, anchor_id) LEFT JOIN ag USING (stream_id, anchor_id)),
cand AS MATERIALIZED (SELECT *, coalesce(array_to_string({words('lines[1]')}[1:12], ' ') || CASE WHEN len({words('lines[1]')}) > 12 THEN '...' ELSE '' END, '') AS hook, array_to_string(lines, ' ') AS said,
  CASE WHEN z >= 3.5 THEN 'INSTANT_CLIMAX_REACTION' WHEN score >= 0.8 THEN 'HOOK_BUILDUP_PAYOFF' WHEN agreed < 0.4 THEN 'HOT_TAKE_AND_DEBATE' ELSE 'HOOK_BUILDUP_PAYOFF' END AS narrative_arc,
  CASE WHEN z >= 3.5 THEN 'HYSTERICAL_LAUGHTER' WHEN score >= 0.8 THEN 'HYPE' WHEN agreed < 0.4 THEN 'CONTROVERSY' ELSE 'EXCITEMENT' END AS primary_emotion FROM zz)"""


SUMMARY = "CASE WHEN length(said) > 160 THEN said[1:160] || '...' ELSE said END"


def _register_shorts() -> None:
    sql = candidates_sql()

    @query(f"WITH RECURSIVE $VIEWS, {sql} SELECT stream_id, anchor_id, round(score, 6) AS score, round(clip_start, 6) AS clip_start, round(clip_end, 6) AS clip_end, round(z, 6) AS z, array_to_string(dominant, ' ') AS dominant, hook, {SUMMARY} AS summary, narrative_arc, primary_emotion FROM cand")
    def clip_candidates(spark, d):
        c = _candidates(spark, d)
        return c.select("stream_id", "anchor_id", r6("score").alias("score"), r6("clip_start").alias("clip_start"), r6("clip_end").alias("clip_end"), r6("z").alias("z"), F.array_join("dominant", " ").alias("dominant"), "hook", "summary", "narrative_arc", "primary_emotion")

    toxic = " + ".join(f"coalesce(bool_or(contains(low, '{w}')), false)::INT" for w in L.TOXIC_TERMS)
    audit = f"""tx AS (SELECT stream_id, timestamp_offset AS f, timestamp_offset AS u, lower(content) AS low FROM chat UNION ALL SELECT stream_id, start_sec, end_sec, lower(transcript) FROM speech),
au AS (SELECT c.stream_id, c.anchor_id, {toxic} AS n FROM cand c LEFT JOIN tx ON tx.stream_id = c.stream_id AND tx.f <= clip_end AND tx.u >= clip_start GROUP BY ALL),
sh AS (SELECT cand.*, CASE WHEN n >= 2 THEN 'REJECTED' WHEN n = 1 THEN 'FLAGGED' ELSE 'PASSED' END AS status FROM cand JOIN au USING (stream_id, anchor_id)),
pt AS (SELECT *, least(100.0, 70.0 + CASE WHEN length(hook) > 0 THEN 15.0 ELSE 0.0 END + CASE WHEN primary_emotion IN ('HYSTERICAL_LAUGHTER', 'HYPE', 'CONTROVERSY') THEN 10.0 ELSE 0.0 END) AS hs, least(100.0, greatest(20.0, 20.0 * z + 30.0)) AS cr,
  CASE WHEN clip_end - clip_start BETWEEN 20 AND 35 THEN 95.0 WHEN clip_end - clip_start BETWEEN 15 AND 50 THEN 80.0 ELSE 65.0 END AS pa, least(100.0, 50.0 + len(dominant) * 12.0) AS me FROM sh),
sc2 AS (SELECT *, (0.35::DOUBLE * hs + 0.25::DOUBLE * cr + 0.2::DOUBLE * pa + 0.2::DOUBLE * me) * CASE status WHEN 'FLAGGED' THEN 0.85 WHEN 'REJECTED' THEN 0.30 ELSE 1.0 END AS ov FROM pt)"""

    def packages(spark, d):
        c = _candidates(spark, d).withColumnsRenamed({"clip_start": "start_sec", "clip_end": "end_sec"}).withColumn("candidate_id", F.concat_ws("_", F.col("stream_id").cast("string"), "anchor_id"))
        texts = V.chat(spark, d).select("stream_id", F.col("timestamp_offset").alias("t"), F.col("content").alias("text"))
        return knowledge.policy_audit(c, texts, ["stream_id"], speech=V.speech(spark, d), bin_size=HOUR)

    @query(f"""WITH RECURSIVE $VIEWS, {sql}, {audit} SELECT stream_id || '_' || anchor_id AS candidate_id, status AS audit_status, narrative_arc, round(hs, 1)::DOUBLE AS hook_strength, round(cr, 1)::DOUBLE AS chat_resonance, round(pa, 1)::DOUBLE AS pacing_score, round(me, 1)::DOUBLE AS meme_potential,
round(ov, 6) AS overall_virality_score, round(least(96, greatest(50, 85 - (clip_end - clip_start) * 0.3 + ov * 0.15)), 6)::DOUBLE AS predicted_completion_rate, array_to_string(list_concat(['#fyp', '#viral', '#gaming', '#streamer', '#twitch'], list_transform(dominant, lambda t: '#' || t)), ' ') AS hashtags FROM sc2""")
    def short_packages(spark, d):
        """Candidates, policy audit, score card and hashtags: the production of shorts from end to end."""
        a = packages(spark, d)
        card = production.score_card(F.col("hook"), F.col("primary_emotion"), F.col("z"), F.col("end_sec") - F.col("start_sec"), F.size("dominant"), F.col("audit_status"))
        digits = {k: 6 if k.startswith(("overall", "predicted")) else 1 for k in card}
        return a.select("candidate_id", "audit_status", "narrative_arc", *[F.round(v, digits[k]).alias(k) for k, v in card.items()], F.array_join(production.hashtags(F.col("dominant"), F.lit(False)), " ").alias("hashtags"))

    @query(f"""WITH RECURSIVE $VIEWS, {sql}, fr AS (SELECT stream_id, frame_index, timestamp_sec FROM keyframes WHERE scene_type = 'FULLSCREEN_CAM'), fc AS (SELECT c.stream_id, c.anchor_id, count(frame_index) > 0 AS full_cam FROM cand c LEFT JOIN fr ON fr.stream_id = c.stream_id AND timestamp_sec BETWEEN clip_start AND clip_end GROUP BY ALL)
SELECT stream_id, anchor_id, CASE WHEN full_cam THEN 0.20 ELSE 0.65 END::DOUBLE AS x, CASE WHEN full_cam THEN 0.80 ELSE 0.45 END::DOUBLE AS h, CASE WHEN contains(primary_emotion, 'LAUGHTER') THEN '&H0000FFFF' WHEN primary_emotion IN ('HYPE', 'EXCITEMENT') THEN '&H0000FF00' ELSE '&H000080FF' END AS highlight_colour, CASE WHEN z >= 3 THEN -14.0 ELSE -10.0 END::DOUBLE AS duck_db FROM cand JOIN fc USING (stream_id, anchor_id)""")
    def cut_plans(spark, d):
        frames = V.keyframes(spark, d).withColumn("detected_objects", F.array().cast("array<struct<label:string,confidence:double,box:array<double>>>"))
        p = production.cut_plans(_candidates(spark, d), frames, ["stream_id"], "anchor_id", "clip_start", "clip_end", "primary_emotion", "z")
        return p.select("stream_id", "anchor_id", "facecam.x", "facecam.h", "highlight_colour", "duck_db")

    @query(f"WITH RECURSIVE $VIEWS, {sql}, {audit} SELECT stream_id || '_' || anchor_id AS candidate_id, round(ov, 6) AS score FROM sc2 WHERE stream_id = 3 AND ov >= 60 ORDER BY round(ov, 6) DESC, candidate_id")
    def shorts_listing(spark, d):
        """The shorts of one recording from a least score on."""
        a = packages(spark, d).where("stream_id = 3")
        card = production.score_card(F.col("hook"), F.col("primary_emotion"), F.col("z"), F.col("end_sec") - F.col("start_sec"), F.size("dominant"), F.col("audit_status"))
        return a.select("candidate_id", r6(card["overall_virality_score"]).alias("score")).where("score >= 60").orderBy(F.desc("score"), "candidate_id")


HIGH = "hl AS (SELECT user_id % 8 AS stream_id, event_id, t, round(value / max(value) OVER (PARTITION BY user_id % 8), 9) AS s FROM ev)"


def _highlights(spark, d):
    e = V.events(spark, d).select((F.col("user_id") % 8).alias("stream_id"), "event_id", "t", "value")
    return e.join(e.groupBy("stream_id").agg(F.max("value").alias("best")), "stream_id").withColumn("s", F.round(F.col("value") / F.col("best"), 9)).drop("value", "best")


@query(f"""WITH RECURSIVE $VIEWS, {HIGH}, st AS (SELECT stream_id, event_id::VARCHAR AS item, t, s FROM hl WHERE s >= 0.60 UNION ALL SELECT stream_id, '', 0.0, NULL FROM bounds),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, item) AS k FROM st),
r AS (SELECT stream_id, k, t AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.stream_id, o.k, CASE WHEN o.t - r.last >= 900 THEN o.t ELSE r.last END, o.t - r.last >= 900 FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1),
c AS (SELECT stream_id, t, CASE WHEN item = '' THEN 'start' WHEN s >= 0.85 THEN 'peak' ELSE 'climax' END AS kind FROM r JOIN o USING (stream_id, k) WHERE kept),
l AS (SELECT stream_id, max(t) AS last FROM c GROUP BY 1) SELECT stream_id, round(t, 6) AS t, kind FROM c UNION ALL SELECT stream_id, round(duration - 300, 6), 'close' FROM l JOIN bounds USING (stream_id) WHERE duration > 1800 AND duration - last >= 600""")
def package_chapters(spark, d):
    out = production.macro_chapters(_highlights(spark, d), V.bounds(V.chat(spark, d)), ["stream_id"], "event_id", "t", "s")
    return out.select("stream_id", r6("t").alias("t"), "kind")


@query(f"WITH $VIEWS, {HIGH} SELECT stream_id, rank, round(t, 1) AS timestamp_sec FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY s DESC, t, event_id)::INT AS rank FROM hl WHERE s >= 0.60) WHERE rank <= 4")
def package_thumbnails(spark, d):
    return production.thumbnails(_highlights(spark, d), ["stream_id"], "event_id", "t", "s")


@query(f"WITH $VIEWS, {HIGH} SELECT stream_id, event_id, round(s, 6) AS score FROM hl WHERE s >= 0.9 ORDER BY t, event_id LIMIT 50")
def event_highlights(spark, d):
    """The first events from a least score on."""
    return _highlights(spark, d).where("s >= 0.9").orderBy("t", "event_id").limit(50).select("stream_id", "event_id", r6("s").alias("score"))


@query(f"""WITH $VIEWS, {HIGH}, tw AS (SELECT stream_id, start_sec + i * 0.4::DOUBLE AS spoken, word FROM (SELECT stream_id, start_sec, unnest(list_filter(regexp_split_to_array(transcript, '\\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(transcript, '\\s+'), lambda x: x <> ''), 1) - 1 AS i FROM speech))
SELECT h.stream_id, event_id, string_agg(word, ' ' ORDER BY spoken, word) AS text, count(*) AS n_words FROM hl h JOIN tw ON tw.stream_id = h.stream_id AND spoken BETWEEN t - 600 AND t + 600 WHERE s >= 0.60 GROUP BY ALL""")
def highlight_words(spark, d):
    """The words spoken within each highlight's clip."""
    w = V.speech(spark, d).select("stream_id", "start_sec", F.posexplode(C.words(F.col("transcript"))).alias("k", "word"))
    spoken = w.select("stream_id", "word", (F.col("start_sec") + F.col("k") * 0.4).alias("start"))
    c = _highlights(spark, d).where("s >= 0.60").select("stream_id", "event_id", (F.col("t") - 600).alias("c0"), (F.col("t") + 600).alias("c1"))
    return production.words_around(spoken, c, ["stream_id"], "event_id", "c0", "c1", 1200.0)


@query("""WITH f AS (SELECT conv_id * 1000 + turn AS frame_id, conv_id % 7 AS a, turn % 5 AS b, length(text) % 3 AS c FROM conversations)
SELECT frame_id, CASE WHEN c = 0 THEN 'person' WHEN a >= b THEN 'person' ELSE 'face' END AS label FROM f""")
def facecam_box(spark, d):
    """The box that is the streamer's camera: the small one farthest from the centre, else the first."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("frame_id"), (F.col("conv_id") % 7).alias("a"), (F.col("turn") % 5).alias("b"), (F.length("text") % 3).alias("c"))
    near = lambda x: F.array(F.lit(0.3) - x * 0.04, F.lit(0.3), F.lit(0.7) - x * 0.04, F.lit(0.7))
    thing = lambda label, box: F.struct(F.lit(label).alias("label"), F.lit(0.9).alias("confidence"), box.alias("box"))
    wide = F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    objects = F.when(F.col("c") == 0, F.array(thing("keyboard", wide), thing("person", wide))).otherwise(F.array(thing("person", near(F.col("a"))), thing("face", near(F.col("b")))))
    return c.select("frame_id", clips.facecam(objects)["label"].alias("label"))


# ---- the chunk index ----------------------------------------------------------------------------


def _chunks(spark, d):
    e = table(spark, d, "embeddings")
    kind = F.element_at(F.array(*map(F.lit, ["speech", "chat", "ocr"])), (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("v"), (F.col("vec_id") % 11).cast("string")).alias("vod_id"), F.concat(F.lit("s"), (F.col("label") % 5).cast("string")).alias("streamer_id"), kind.alias("content_type"), (F.col("vec_id") * 2.0).alias("timestamp_sec"), "embedding")


@query(f"""SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 6) AS score FROM embeddings, {QVEC} WHERE label % 5 IN (1, 2) AND vec_id % 3 = 0 AND vec_id * 2.0 BETWEEN 10 AND 100000 ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) DESC, vec_id LIMIT 10""")
def filtered_knn(spark, d):
    out = index.nearest(_chunks(spark, d), _query_vector(spark, d), 10, digits=9, streamer_ids=["s1", "s2"], content_types=["speech"], start=10.0, end=100000.0)
    return out.withColumn("score", r6("score"))


@query(f"SELECT vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], qv), 3) AS score FROM embeddings, {QVEC} ORDER BY round(list_inner_product(embedding::DOUBLE[], qv), 3) DESC, vec_id LIMIT 5")
def vector_index_query(spark, d):
    return index.nearest(_chunks(spark, d), _query_vector(spark, d), 5, "dot", 3)


@query("""WITH c AS (SELECT doc_id AS chunk_id, source AS vod_id, lang AS streamer_id, CASE WHEN doc_id % 10 = 0 THEN 'claim' ELSE 'speech' END AS content_type, text FROM documents WHERE source <> 'src0' AND (trim(text) <> '' OR doc_id % 10 <> 0))
SELECT content_type, count(*) AS n_chunks, count(DISTINCT vod_id) AS n_vods, count(DISTINCT streamer_id) AS n_streamers FROM c GROUP BY content_type""")
def chunk_store(spark, d):
    """Insert, insert again with other kinds, delete one recording, and count what is left."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("vod_id"), F.col("lang").alias("streamer_id"), F.lit("speech").alias("content_type"), "text")
    again = chunks.where("chunk_id % 10 = 0").withColumn("content_type", F.lit("claim"))
    return search.index_stats(index.delete_vod(index.insert(chunks, again), "src0"))


@query(f"""WITH RECURSIVE $VIEWS, {CLAIMS}, o AS MATERIALIZED (SELECT stream_id, start_sec AS s, end_sec AS e, transcript AS t, row_number() OVER (PARTITION BY stream_id ORDER BY start_sec, end_sec, transcript) AS k FROM speech WHERE trim(transcript) <> ''),
r AS (SELECT stream_id, k, 0 AS n, s AS begin FROM o WHERE k = 1 UNION ALL SELECT o.stream_id, o.k, r.n + (o.e - r.begin > 3600)::INT, CASE WHEN o.e - r.begin > 3600 THEN greatest(0.0, o.s - 60) ELSE r.begin END FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1),
g AS (SELECT stream_id, min(begin) AS b, arg_max(e, k) AS e, string_agg(t, ' ' ORDER BY k) AS text FROM r JOIN o USING (stream_id, k) GROUP BY stream_id, n)
SELECT stream_id || '_speech_' || floor(b)::BIGINT || '_' || floor(e)::BIGINT AS chunk_id, 'speech' AS content_type, b AS timestamp_sec, length(trim(text))::INT AS size FROM g
UNION ALL SELECT stream_id || '_chat_' || floor(timestamp_offset)::BIGINT, 'chat', round(timestamp_offset, 6), length('burst of KEKW x 2.0')::INT FROM chat WHERE contains(content, 'KEKW')
UNION ALL SELECT stream_id || '_ocr_' || floor(timestamp_sec)::BIGINT, 'ocr', round(timestamp_sec, 6), length(screen_summary || CASE WHEN len(ocr_text_blocks) > 0 THEN '. OCR: ' || array_to_string(ocr_text_blocks, ' ') ELSE '' END)::INT FROM keyframes
UNION ALL SELECT cl.stream_id || '_claim_' || segment_id, 'claim', start_sec, length('claim on all: ' || trim(transcript) || ' (' || stance || ')')::INT FROM cl JOIN speech USING (stream_id, segment_id) WHERE stance IS NOT NULL""")
def full_index(spark, d):
    """Chunks of speech, chat bursts, screens and claims."""
    said = folds.chunked(V.speech(spark, d), ["stream_id"], "start_sec", "end_sec", "transcript", 3600.0, 60.0)
    ids = lambda df: df.withColumns({"vod_id": F.col("stream_id"), "streamer_id": F.concat(F.lit("s"), F.col("stream_id").cast("string"))})
    bursts = V.chat(spark, d).where(F.contains("content", F.lit("KEKW"))).select("stream_id", F.col("timestamp_offset").alias("t"), F.lit("KEKW").alias("token"), F.lit(2.0).alias("times"))
    found = knowledge.claims(V.speech(spark, d), ["stream_id", "segment_id", "start_sec"])
    claims = found.select("stream_id", F.col("segment_id").alias("claim_id"), F.col("start_sec").alias("t"), F.lit("all").alias("subject_entity"), "raw_quote", F.col("stance").alias("verdict"))
    out = index.build(ids(said), ids(bursts), ids(V.keyframes(spark, d)), ids(claims))
    return out.select("chunk_id", "content_type", r6("timestamp_sec").alias("timestamp_sec"), F.length("text").alias("size"))


SUBJECT = r"""CASE WHEN len(caps) > 0 THEN array_to_string(caps[1:2], ' ') ELSE 'Stream Topic' END"""
SUBJECTS = rf"""{CLAIMS}, cs AS (SELECT cl.*, start_sec, list_transform(list_filter(regexp_split_to_array(trim(transcript), '\s+'), lambda w: w <> '' AND w[1] <> lower(w[1]) AND lower(w) NOT IN ({', '.join(f"'{w}'" for w in L.NO_SUBJECT)})), lambda w: trim(w, '.,!?')) AS caps FROM cl JOIN speech USING (stream_id, segment_id) WHERE stance IS NOT NULL)"""


@query(f"""WITH $VIEWS, {SUBJECTS} SELECT stream_id, {SUBJECT} AS subject_entity, round(avg(polarity), 9) AS polarity, count(*) AS claims_count, CASE WHEN round(avg(polarity), 9) >= 0.35 THEN 'APPROVAL' WHEN round(avg(polarity), 9) <= -0.35 THEN 'DISAPPROVAL' ELSE 'NEUTRAL' END AS overall_stance FROM cs GROUP BY ALL""")
def streamer_knowledge(spark, d):
    """The stance of every creator on every subject, from all claims."""
    b = knowledge.beliefs(knowledge.claims(V.speech(spark, d), ["stream_id", "segment_id"]), ["stream_id"])
    return b.select("stream_id", "subject_entity", r9("aggregate_polarity").alias("polarity"), "claims_count", knowledge.stance_of(F.round("aggregate_polarity", 9)).alias("overall_stance"))


@query(f"WITH $VIEWS, {SUBJECTS} SELECT lower({SUBJECT}) AS entity, stance, polarity AS numeric_value, stream_id, start_sec FROM cs WHERE trim({SUBJECT}) <> ''")
def observations(spark, d):
    found = knowledge.claims(V.speech(spark, d), ["stream_id", "segment_id", "start_sec"])
    return registry.observations(found, ["stream_id", "start_sec"]).select("entity", "stance", "numeric_value", "stream_id", "start_sec")


@query("""WITH q AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda w: length(w) > 3) AS ws FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, turn AS p_turn, lower(text) AS post FROM conversations WHERE role <> 'user')
SELECT conv_id, turn, p_turn FROM q JOIN p USING (conv_id) WHERE len(list_filter(ws, lambda w: contains(post, lower(w)))) > 0""")
def post_relevance(spark, d):
    c = table(spark, d, "conversations")
    posts = c.where("role <> 'user'").select("conv_id", F.col("turn").alias("p_turn"), F.col("text").alias("post_text"))
    return index.relevant_posts(c.where("role = 'user'").select("conv_id", "turn", "text"), posts, ["conv_id"], "turn", "text").select("conv_id", "turn", "p_turn")


# ---- registries ---------------------------------------------------------------------------------


@query("""WITH r AS (SELECT 'r' || o_orderkey AS run_id, o_orderdate::DATE AS ts, o_orderstatus = 'P' AS wants FROM orders), c AS (SELECT max(struct_pack(t := ts, r := run_id)).r AS chosen FROM r WHERE wants)
SELECT run_id, ts AS run_date, run_id = chosen AS is_baseline FROM r, c ORDER BY ts DESC, run_id DESC LIMIT 20""")
def audit_registry(spark, d):
    """Runs recorded in two batches: the last that asks for it is the only baseline; the most recent ones."""
    o = table(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").cast("date").alias("timestamp"), (F.col("o_orderstatus") == "P").alias("is_baseline"))
    first = registry.record_runs(o.limit(0), o.withColumn("is_baseline", F.lit(False)))
    return registry.recent(registry.record_runs(first, o), 20).select("run_id", F.col("timestamp").alias("run_date"), "is_baseline")


@query("SELECT l_suppkey::VARCHAR AS run_id, count(*) AS n_stages, count(*) FILTER (l_returnflag = 'R') AS n_failed, round(sum(l_quantity), 6) AS total_sec, round(sum(l_quantity) / 3600, 9) AS real_time_factor FROM lineitem GROUP BY l_suppkey")
def telemetry_totals(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("run_id"), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("SUCCESS").alias("status"), F.col("l_quantity").cast("double").alias("duration_sec"))
    return registry.run_totals(s, 3600.0).withColumns({"total_sec": r6("total_sec"), "real_time_factor": r9("real_time_factor")})


@query("""SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'NO_SUCH_TARGET' WHEN o_orderkey IS NOT NULL THEN 'ALREADY_KNOWN' ELSE 'QUEUED' END AS status FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN orders ON o_orderkey = event_id""")
def enqueue_requests(spark, d):
    r = table(spark, d, "events").select("event_id", F.col("user_id").alias("c_custkey"), F.col("event_id").alias("o_orderkey"))
    return registry.enqueued(r, table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_orderkey").select("event_id", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'DONE' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 2 = 0 THEN 'seen' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def status_update(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    change = table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("DONE").alias("o_orderstatus"), F.when(F.col("o_custkey") % 2 == 0, "seen").alias("o_orderpriority"))
    return registry.updated(o, change, "o_orderkey")


def _lexicon(spark, d):
    per = table(spark, d, "events").groupBy(F.concat(F.col("event_type"), (F.col("user_id") % 6).cast("string")).alias("term")).agg(F.count(F.lit(1)).alias("occurrences"), F.max(F.col("ts").cast("timestamp")).alias("last_seen"))
    intent = F.element_at(F.array(*map(F.lit, ["HYPE", "NEUTRAL", "AMUSEMENT"])), (F.col("occurrences") % 3 + 1).cast("int"))
    return per.withColumns({"confidence": 0.7 + (F.col("occurrences") % 30) / 100.0, "intent": intent})


LEX = """lx AS (SELECT event_type || (user_id % 6) AS term, count(*) AS occurrences, max(ts) AS last_seen FROM events GROUP BY 1),
lp AS (SELECT *, 0.7::DOUBLE + (occurrences % 30) / 100.0::DOUBLE AS confidence, CASE occurrences % 3 WHEN 0 THEN 'HYPE' WHEN 1 THEN 'NEUTRAL' ELSE 'AMUSEMENT' END AS intent FROM lx),
ls AS (SELECT *, CASE WHEN (occurrences % 2 = 0 AND confidence >= 0.85) OR (occurrences % 2 = 1 AND confidence >= 0.80 AND occurrences >= 15) THEN 'PROMOTED' ELSE 'ACTIVE' END AS status FROM lp)"""


@query(f"WITH {LEX} SELECT intent, array_to_string(list_sort(list(DISTINCT term)), ' ') AS terms FROM ls WHERE intent <> 'NEUTRAL' GROUP BY intent")
def active_lexicon(spark, d):
    state = registry.lexicon_status(_lexicon(spark, d), F.col("occurrences") % 2 == 0)
    return registry.active_lexicon(state).select("intent", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {LEX} SELECT term, occurrences, round(confidence * pow(2, -greatest(0, epoch(TIMESTAMP '2024-02-10' - date_trunc('second', last_seen)) / 86400.0) / 14), 6) AS current_confidence FROM ls WHERE status = 'PROMOTED'")
def lexicon_listing(spark, d):
    state = registry.lexicon_status(_lexicon(spark, d), F.col("occurrences") % 2 == 0)
    return registry.lexicon_listing(state, F.lit("2024-02-10").cast("timestamp"), "PROMOTED").select("term", "occurrences", r6("current_confidence").alias("current_confidence"))


# ---- chat, co-streams and time ------------------------------------------------------------------


def influence_sql() -> str:
    from vodlens.plans.oracles import ORACLES

    return ORACLES["chatter_influence"]


def _register_influence() -> None:
    head, _, tail = influence_sql().rpartition("\nSELECT author_name, total_messages")
    ranked = f"{head}, fin AS (SELECT author_name, total_messages{tail}), us AS (SELECT author_name, arg_max(user_id, struct_pack(a := timestamp_offset, b := message_id)) AS user_id FROM chat GROUP BY 1)"

    @query(f"{ranked} SELECT author_name, user_id, round(influence_score, 3) AS influence_score, row_number() OVER (ORDER BY round(influence_score, 3) DESC, total_messages DESC, author_name)::INT AS rank FROM fin JOIN us USING (author_name) ORDER BY rank LIMIT 20")
    def influence_leaderboard(spark, d):
        from vodlens.operators import chat as chat_ops
        from vodlens.plans.catalog import meme_bursts

        chat = V.chat(spark, d)
        origins = chat.join(meme_bursts(spark, d).select(F.col("seed").alias("message_id")), "message_id").select("author_name")
        scores = chat_ops.influence(chat, origins, chat_ops.responses(chat, V.speech(spark, d), ["stream_id"], longest=1800.0)).withColumn("influence_score", F.round("influence_score", 3))
        return registry.leaderboard(scores, "influence_score", [F.desc("total_messages"), F.col("author_name")], 20).select("author_name", "user_id", "influence_score", "rank")


@query(f"""WITH $VIEWS, clex(token, p) AS (VALUES {CROSS}), al AS (SELECT *, timestamp_offset - CASE channel_id WHEN 1 THEN 2.5 WHEN 2 THEN -1.0 ELSE 0 END AS u FROM chat),
ms AS (SELECT message_id, coalesce(avg(p), 0) AS s FROM (SELECT message_id, unnest(string_split(lower(content), ' ')) AS token FROM chat) LEFT JOIN clex USING (token) GROUP BY message_id),
bk AS (SELECT stream_id, platform, floor((u - min(u) OVER (PARTITION BY stream_id)) / {DAY})::BIGINT AS bucket_index, s FROM al JOIN ms USING (message_id)), pf AS (SELECT stream_id, bucket_index, platform, avg(s) AS m, count(*) AS n FROM bk GROUP BY ALL),
tl AS (SELECT stream_id, bucket_index, max(m) - min(m) AS spread FROM pf GROUP BY ALL HAVING sum(n) >= 3)
SELECT stream_id, rank, bucket_index, round(spread, 9) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY round(spread, 9) DESC, bucket_index)::INT AS rank FROM tl) WHERE rank <= 5""")
def divergent_points(spark, d):
    t = costream.sentiment_timeline(_aligned(spark, d), ["stream_id"], width=DAY)
    return costream.most_divergent(t, ["stream_id"]).select("stream_id", "rank", "bucket_index", r9("spread").alias("spread"))


@query(f"WITH $VIEWS SELECT stream_id, floor(timestamp_offset / 1800)::BIGINT AS part, count(*) AS n, round(min(timestamp_offset) - floor(timestamp_offset / 1800)::BIGINT * 1800.0, 6) AS first_sec FROM chat GROUP BY stream_id, floor(timestamp_offset / 1800)::BIGINT")
def processing_parts(spark, d):
    """Chat dealt to the parts of 1800 seconds that are worked on one by one, on each part's own clock."""
    part = temporal.bucket(F.col("timestamp_offset"), 1800.0)
    rows = V.chat(spark, d).withColumn("part", part).groupBy("stream_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_offset").alias("first"))
    return rows.select("stream_id", "part", "n", r6(F.col("first") - F.col("part") * 1800.0).alias("first_sec"))


@query("WITH $VIEWS SELECT 'chat' AS kind, count(*) AS n FROM chat WHERE stream_id = 3 UNION ALL SELECT 'speech', count(*) FROM speech WHERE stream_id = 3")
def filtered_counts(spark, d):
    n = lambda df, kind: df.where("stream_id = 3").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(V.chat(spark, d), "chat").unionByName(n(V.speech(spark, d), "speech"))


@query("""WITH $VIEWS SELECT s.stream_id, s.segment_id, CASE WHEN e.label IS NULL THEN s.speaker_label WHEN e.label % 2 = 0 THEN 'creator_' || e.label ELSE s.speaker_label END AS speaker_label FROM speech s LEFT JOIN embeddings e ON e.vec_id = s.segment_id""")
def segment_attribution(spark, d):
    """Segments with the enrolled creator whose embedding is theirs; others keep their label."""
    known = table(spark, d, "embeddings").select(F.col("vec_id").alias("segment_id"), F.when(F.col("label") % 2 == 0, F.concat(F.lit("creator_"), F.col("label").cast("string"))).alias("assigned"))
    return media.attributed(V.speech(spark, d), known, "segment_id").select("stream_id", "segment_id", "speaker_label")


def _register_sampling() -> None:
    from vodlens.plans.oracles import BURSTS

    @query(f"""WITH RECURSIVE $VIEWS, {DENSE}, {BURSTS}, loud AS (SELECT stream_id, greatest(0.0, start_sec - 1) AS lo, end_sec + 3 AS hi FROM speech WHERE contains(transcript, '!') OR contains(lower(transcript), 'wow')),
sp AS (SELECT stream_id, bucket_index * {HOUR} AS lo, bucket_index * {HOUR} + {HOUR} AS hi FROM zb UNION ALL SELECT * FROM loud),
hot AS MATERIALIZED (SELECT b.stream_id, duration, list(struct_pack(lo := lo, hi := hi)) FILTER (lo IS NOT NULL) AS spans FROM bounds b LEFT JOIN sp USING (stream_id) GROUP BY ALL),
steps AS (SELECT stream_id, 0.0::DOUBLE AS t FROM hot WHERE duration > 0 UNION ALL SELECT stream_id, t2 FROM (SELECT s.stream_id, duration, s.t + CASE WHEN len(list_filter(coalesce(spans, []), lambda x: s.t BETWEEN x.lo AND x.hi)) > 0 THEN 600 ELSE 6000 END AS t2 FROM steps s JOIN hot USING (stream_id)) WHERE t2 < duration),
al3 AS (SELECT DISTINCT stream_id, round(t, 3) AS t FROM (SELECT * FROM steps UNION ALL SELECT k.stream_id, timestamp_sec + 0.1 FROM keyframes k JOIN bounds USING (stream_id) WHERE scene_type = 'REACT_VIDEO' AND timestamp_sec >= 0 AND timestamp_sec < duration) JOIN bounds USING (stream_id) WHERE round(t, 3) <= duration),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS k FROM al3),
r AS (SELECT stream_id, k, t AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.stream_id, o.k, CASE WHEN o.t - r.last >= 0.15 THEN o.t ELSE r.last END, o.t - r.last >= 0.15 FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
SELECT stream_id, t AS timestamp_sec FROM r JOIN o USING (stream_id, k) WHERE kept""")
    def sampling_plan(spark, d):
        """Sampling times from chat bursts, speech bursts and scene cuts together."""
        b = temporal.z_bursts(_dense(spark, d), ["stream_id"]).select("stream_id", (F.col("bucket_index") * HOUR).alias("lo"), ((F.col("bucket_index") + 1) * HOUR).alias("hi"))
        said = V.speech(spark, d).where(F.contains("transcript", F.lit("!")) | F.contains(F.lower("transcript"), F.lit("wow"))).select("stream_id", F.greatest(F.lit(0.0), F.col("start_sec") - 1).alias("lo"), (F.col("end_sec") + 3).alias("hi"))
        cuts = V.keyframes(spark, d).where("scene_type = 'REACT_VIDEO'").select("stream_id", F.col("timestamp_sec").alias("cut"))
        return folds.sampling_plan(V.bounds(V.chat(spark, d)), b.unionByName(said), cuts, ["stream_id"], 600.0, 6000.0)


EMOTES = ", ".join(f"'{k}'" for k in L.EMOTE_POLARITY)


@query(f"WITH $VIEWS SELECT message_id, round(timestamp_offset, 6) AS t FROM chat WHERE len(list_filter(string_split(content, ' '), lambda w: w IN ({EMOTES}))) > 0 OR length(content) > 20")
def emote_triggers(spark, d):
    """The times of messages with an emote, or of over twenty characters."""
    emotes = F.filter(C.words(F.col("content")), lambda w: w.isin(*L.EMOTE_POLARITY))
    return V.chat(spark, d).where((F.size(emotes) > 0) | (F.length("content") > 20)).select("message_id", r6("timestamp_offset").alias("t"))


FEED = " OR ".join(f"contains(lower(text), '{w}')" for w in L.KILLFEED)
KNOWN = " OR ".join(f"contains(lower(m), '{w}')" for w in L.SITES)


@query(rf"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(lines, lambda x: regexp_extract(x, '{media.HANDLE}', 1)), lambda h: h <> '')[1] AS handle, list_filter(regexp_extract_all(text, '{media.ADDRESS}', 1), lambda m: {KNOWN})[1] AS url, {FEED} AS killfeed FROM l)
SELECT * FROM c WHERE handle IS NOT NULL OR url IS NOT NULL OR killfeed""")
def dense_frames(spark, d):
    """Each frame's first post, address and kill feed together."""
    docs = table(spark, d, "documents")
    cards = media.screen_cards(docs.select("doc_id", F.array("text").alias("ocr_text_blocks")), ["doc_id"])
    first = cards.groupBy("doc_id").agg(F.min_by("handle", F.struct("block_no", "line_no")).alias("handle"))
    seen = docs.select("doc_id", media.screen_address(F.col("text"))["url"].alias("url"), media.is_killfeed(F.col("text")).alias("killfeed"))
    return seen.join(first, "doc_id", "left").where("handle is not null or url is not null or killfeed").select("doc_id", "handle", "url", "killfeed")


# ---- live ---------------------------------------------------------------------------------------


def _timed_stream(spark, d):
    return _event_stream(spark, d).withColumn("t", F.unix_micros("ts") / 1e6 - V.ORIGIN)


@query("WITH $VIEWS SELECT user_id, event_id FROM (SELECT *, max(t) OVER (PARTITION BY user_id) AS last FROM ev) WHERE t >= last - 2 * 86400.0")
def stream_rolling_buffer(spark, d):
    from vodlens.streaming import coordinator, live

    out = live.run_available(coordinator.rolling_buffer(_timed_stream(spark, d), "user_id", "t", "event_id", DAY), "rolling", "update")
    return out.select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 7")
def stream_full_queue(spark, d):
    """A queue that drops what comes once it is full."""
    from vodlens.streaming import coordinator, live

    out = live.run_available(coordinator.bounded_queue(_timed_stream(spark, d), "user_id", "t", "event_id", 7, "newest"), "queue", "update")
    return out.select("user_id", "event_id")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 250) WHERE event_type IN ('click', 'error')")
def live_replay(spark, d):
    from vodlens.streaming import coordinator

    return coordinator.replay(table(spark, d, "events"), ["ts", "event_id"], 250, ["click", "error"]).select("event_id", "event_type")


@query(f"""WITH $VIEWS, l AS (SELECT stream_id, count(*) AS n_messages, count(DISTINCT platform) AS n_platforms, max(timestamp_offset) AS last_ts FROM chat GROUP BY 1), r AS (SELECT stream_id, count(*) / {HOUR} AS velocity FROM chat JOIN l USING (stream_id) WHERE timestamp_offset > last_ts - {HOUR} GROUP BY 1)
SELECT stream_id, n_messages, n_platforms, round(last_ts, 6) AS last_ts, round(velocity, 9) AS velocity, max(last_ts) OVER () - last_ts <= {60 * HOUR} AS is_live FROM l JOIN r USING (stream_id)""")
def live_status(spark, d):
    from vodlens.streaming import coordinator

    out = coordinator.status(V.chat(spark, d), ["stream_id"], "timestamp_offset", window_sec=HOUR)
    return out.withColumns({"last_ts": r6("last_ts"), "velocity": r9("velocity")})


@query(f"""WITH $VIEWS, clex(token, p) AS (VALUES {CROSS}), al0 AS (SELECT *, timestamp_offset - CASE channel_id WHEN 1 THEN 2.5 WHEN 2 THEN -1.0 ELSE 0 END AS u FROM chat), al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY u DESC, message_id DESC) AS i FROM al0) WHERE i <= 500),
ms AS (SELECT message_id, coalesce(avg(p), 0) AS s FROM (SELECT message_id, unnest(string_split(lower(content), ' ')) AS token FROM chat) LEFT JOIN clex USING (token) GROUP BY message_id),
bk AS (SELECT stream_id, platform, floor((u - min(u) OVER (PARTITION BY stream_id)) / {6 * HOUR})::BIGINT AS bucket_index, s FROM al JOIN ms USING (message_id)), pf AS (SELECT stream_id, bucket_index, platform, avg(s) AS m, count(*) AS n FROM bk GROUP BY ALL)
SELECT stream_id, bucket_index, sum(n)::BIGINT AS n_messages, round(max(m) - min(m), 9) AS spread FROM pf GROUP BY ALL HAVING sum(n) >= 3 AND max(m) - min(m) >= 0.75""")
def audience_alerts(spark, d):
    from vodlens.streaming import coordinator

    out = coordinator.audience_alerts(_aligned(spark, d), ["stream_id"], 500, 6 * HOUR)
    return out.select("stream_id", "bucket_index", "n_messages", r9("spread").alias("spread"))


def register() -> None:
    _register_shorts()
    _register_influence()
    _register_sampling()
