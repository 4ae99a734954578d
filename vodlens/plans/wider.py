"""Queries of whole chains: publication packages, the full index, timelines, citations, sampling runs, feeders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.operators import folds, index, knowledge, media, production, registry, store, temporal
from vodlens.plans import views as V
from vodlens.plans.catalog import CLAIMS, DENSE, HOUR, _dense, _matrix, query, r6
from vodlens.plans.deep import _folder
from vodlens.plans.making import HIGH, _highlights
from vodlens.plans.oracles import BURSTS, MATRIX
from vodlens.plans.views import table

LABELS = {"start": "Start", "climax": "Climax {k}", "peak": "Peak {k}", "close": "Close"}
CLOCK = "CASE WHEN floor(t) < 3600 THEN printf('%02d:%02d', floor(t)::BIGINT // 60, floor(t)::BIGINT % 60) ELSE printf('%02d:%02d:%02d', floor(t)::BIGINT // 3600, floor(t)::BIGINT // 60 % 60, floor(t)::BIGINT % 60) END"


@query(f"""WITH RECURSIVE $VIEWS, {HIGH}, st AS (SELECT stream_id, event_id::VARCHAR AS item, t, s FROM hl WHERE s >= 0.60 UNION ALL SELECT stream_id, '', 0.0, NULL FROM bounds),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, item) AS k FROM st),
r AS (SELECT stream_id, k, t AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.stream_id, o.k, CASE WHEN o.t - r.last >= 43200 THEN o.t ELSE r.last END, o.t - r.last >= 43200 FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1),
c AS (SELECT stream_id, t, CASE WHEN item = '' THEN 'start' WHEN s >= 0.85 THEN 'peak' ELSE 'climax' END AS kind FROM r JOIN o USING (stream_id, k) WHERE kept),
l AS (SELECT stream_id, max(t) AS last FROM c GROUP BY 1), ch AS (SELECT * FROM c UNION ALL SELECT stream_id, duration - 300, 'close' FROM l JOIN bounds USING (stream_id) WHERE duration > 1800 AND duration - last >= 600),
nm AS (SELECT stream_id, t, kind, count(*) FILTER (kind IN ('climax', 'peak')) OVER (PARTITION BY stream_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM ch),
ln AS (SELECT stream_id, list({CLOCK} || ' - ' || CASE kind WHEN 'start' THEN 'Start' WHEN 'close' THEN 'Close' WHEN 'peak' THEN 'Peak ' || k ELSE 'Climax ' || k END ORDER BY t) AS lines FROM nm GROUP BY 1),
th AS (SELECT stream_id, list(round(t, 1) ORDER BY rk) AS top FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY s DESC, t, event_id) AS rk FROM hl WHERE s >= 0.60) WHERE rk <= 4 GROUP BY 1),
ns AS (SELECT stream_id, count(*) AS n FROM hl WHERE s >= 0.60 GROUP BY 1)
SELECT stream_id, 'All of it live: ' || floor(duration / 3600)::BIGINT || ' hours with Creator ' || stream_id AS title, 'creator ' || stream_id AS tag, array_to_string(lines, '|') AS chapters, array_to_string(top, '|') AS thumbnails,
(SELECT 'Live for ' || {CLOCK} || ' with ' || coalesce(n, 0) || ' highlight moments.' FROM (SELECT duration AS t)) AS recap FROM bounds JOIN ln USING (stream_id) LEFT JOIN th USING (stream_id) LEFT JOIN ns USING (stream_id)""")
def publication_package(spark, d):
    """Titles, chapters, recap, tags and thumbnails of every recording."""
    b, h = V.bounds(V.chat(spark, d)), _highlights(spark, d)
    chapters = production.macro_chapters(h, b, ["stream_id"], "event_id", "t", "s", 43200.0)
    p = production.publication(chapters, h, b, ["stream_id"], F.concat(F.lit("Creator "), F.col("stream_id").cast("string")), "t", "s", "event_id", LABELS)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return p.select("stream_id", F.get("titles", F.lit(2)).alias("title"), F.get("tags", F.lit(0)).alias("tag"), joined("chapter_lines").alias("chapters"), joined("thumbnails").alias("thumbnails"), F.get("recap", F.lit(0)).alias("recap"))


@query("""WITH $VIEWS, c AS (SELECT stream_id, 'seg_' || segment_id AS chunk_id, start_sec AS t, transcript AS text FROM speech UNION ALL SELECT stream_id, 'frame_' || frame_index, timestamp_sec, screen_summary FROM keyframes),
j AS (SELECT c.*, author_name, content, timestamp_offset AS o, row_number() OVER (PARTITION BY c.stream_id, chunk_id ORDER BY timestamp_offset, message_id) AS r FROM c JOIN chat ON chat.stream_id = c.stream_id AND timestamp_offset BETWEEN t - 900 AND t + 900),
g AS (SELECT stream_id, chunk_id, count(*)::INT AS n, string_agg(author_name || ': ' || content, '|' ORDER BY r) AS context FROM j WHERE r <= 10 GROUP BY 1, 2)
SELECT stream_id, chunk_id, coalesce(n, 0) AS n_context, coalesce(context, '') AS context, CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9_]+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM c LEFT JOIN g USING (stream_id, chunk_id)""")
def index_chunks(spark, d):
    """Chunks of speech and screens with their chat context and their embeddings."""
    said = V.speech(spark, d).select("stream_id", F.concat(F.lit("seg_"), "segment_id").alias("chunk_id"), F.col("start_sec").alias("timestamp_sec"), F.col("transcript").alias("text"))
    seen = V.keyframes(spark, d).select("stream_id", F.concat(F.lit("frame_"), "frame_index").alias("chunk_id"), "timestamp_sec", F.col("screen_summary").alias("text"))
    full = index.with_embeddings(index.with_context(said.unionByName(seen), V.chat(spark, d), ["stream_id"], 900.0))
    text = F.array_join(F.transform("chat_context", lambda m: F.concat(m["author"], F.lit(": "), m["text"])), "|")
    return full.select("stream_id", "chunk_id", F.size("chat_context").alias("n_context"), text.alias("context"), r6(C.norm(F.col("embedding"))).alias("norm"))


@query("""WITH c AS (SELECT doc_id AS chunk_id, source AS vod_id, lang AS content_type, text FROM documents WHERE source IS NOT NULL AND trim(text) <> ''), b AS (SELECT chunk_id + 1000000 AS chunk_id, vod_id, 'again' AS content_type, text FROM c WHERE vod_id IN ('src0', 'src2') AND chunk_id % 3 = 0)
SELECT vod_id, content_type, count(*) AS n, min(chunk_id) AS first FROM (SELECT * FROM c WHERE vod_id NOT IN (SELECT vod_id FROM b) UNION ALL SELECT * FROM b) GROUP BY ALL""")
def reindexed_chunks(spark, d):
    """Two recordings indexed anew: what they had goes, in one version of the kept index."""
    from vodlens.sources import state

    c = table(spark, d, "documents").where("source IS NOT NULL AND trim(text) <> ''").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("vod_id"), F.col("lang").alias("content_type"), "text")
    again = c.where(F.col("vod_id").isin("src0", "src2") & (F.col("chunk_id") % 3 == 0)).withColumns({"chunk_id": F.col("chunk_id") + 1_000_000, "content_type": F.lit("again")})
    kept = state.StateTable(spark, _folder(spark, "index"))
    kept.commit(c, None)
    kept.update(lambda now: index.reindexed(now, again))
    return kept.read().groupBy("vod_id", "content_type").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))


@query(f"""WITH $VIEWS, {CLAIMS}, {DENSE}, {BURSTS}
SELECT stream_id, 'speech' AS track, start_sec AS start, end_sec AS end_sec, speaker_label AS label FROM speech UNION ALL SELECT stream_id, 'keyframe', round(timestamp_sec, 6), round(timestamp_sec, 6), scene_type FROM keyframes
UNION ALL SELECT cl.stream_id, 'claim', start_sec, start_sec, stance FROM cl JOIN speech USING (stream_id, segment_id) WHERE stance IS NOT NULL UNION ALL SELECT stream_id, 'burst', bucket_index * {HOUR}, (bucket_index + 1) * {HOUR}, round(z, 3)::VARCHAR FROM zb""")
def timeline_tracks(spark, d):
    """The rows of a recording's timeline, track by track."""
    said, frames = V.speech(spark, d), V.keyframes(spark, d)
    row = lambda df, track, a, b, label: df.select("stream_id", F.lit(track).alias("track"), a.alias("start"), b.alias("end_sec"), label.alias("label"))
    claims = knowledge.claims(said, ["stream_id", "start_sec"])
    bursts = temporal.z_bursts(_dense(spark, d), ["stream_id"])
    t = r6("timestamp_sec")
    out = row(said, "speech", F.col("start_sec"), F.col("end_sec"), F.col("speaker_label")).unionByName(row(frames, "keyframe", t, t, F.col("scene_type")))
    out = out.unionByName(row(claims, "claim", F.col("start_sec"), F.col("start_sec"), F.col("stance")))
    return out.unionByName(row(bursts, "burst", F.col("bucket_index") * HOUR, (F.col("bucket_index") + 1) * HOUR, F.round("z_score", 3).cast("string")))


@query(f"""WITH $VIEWS, {MATRIX}, c AS (SELECT stream_id, count(*) AS n_chat FROM chat GROUP BY 1), s AS (SELECT stream_id, count(*) AS n_speech FROM speech GROUP BY 1), k AS (SELECT stream_id, count(*) AS n_frames FROM keyframes GROUP BY 1),
m AS (SELECT stream_id, count(*) AS n_slices, round(avg(round(agreement_score, 9)), 6) AS agreement FROM mat GROUP BY 1) SELECT stream_id, n_chat, coalesce(n_speech, 0) AS n_speech, coalesce(n_frames, 0) AS n_frames, n_slices, agreement, round(duration, 2) AS media_sec FROM c JOIN bounds USING (stream_id) LEFT JOIN s USING (stream_id) LEFT JOIN k USING (stream_id) LEFT JOIN m USING (stream_id)""")
def manifest_counts(spark, d):
    """A manifest's counts of each recording, and the mean agreement over the slices that have one."""
    n = lambda df, name: df.groupBy("stream_id").agg(F.count(F.lit(1)).alias(name))
    m = _matrix(spark, d).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_slices"), r6(F.avg(F.round("agreement_score", 9))).alias("agreement"))
    c = V.chat(spark, d)
    out = n(c, "n_chat").join(V.bounds(c), "stream_id")
    for part in (n(V.speech(spark, d), "n_speech"), n(V.keyframes(spark, d), "n_frames"), m):
        out = out.join(part, "stream_id", "left")
    return out.fillna(0, ["n_speech", "n_frames"]).select("stream_id", "n_chat", "n_speech", "n_frames", "n_slices", "agreement", F.round("duration", 2).alias("media_sec"))


RULES = [
    {"keywords": ["tion ", "Ción"], "url": "https://one.example/a", "domain": "one.example", "title": "First rule", "confidence": 0.9},
    {"keywords": [" de "], "url": "https://two.example/b", "domain": "two.example", "title": "Second rule", "confidence": 0.95},
]
FALLBACK = {"url": "https://wiki.example/{query}", "domain": "wiki.example", "title": "On {query}", "confidence": 0.75}


@query("""SELECT item_id, CASE WHEN a THEN 'https://one.example/a' WHEN b THEN 'https://two.example/b' ELSE 'https://wiki.example/' || replace(url_encode(text[1:30]), '%2F', '/') END AS url, CASE WHEN a THEN 'First rule' WHEN b THEN 'Second rule' ELSE 'On ' || text[1:40] END AS title, CASE WHEN a THEN 0.9 WHEN b THEN 0.95 ELSE 0.75 END::DOUBLE AS confidence
FROM (SELECT *, contains(lower(text), 'tion ') OR contains(lower(text), 'ción') AS a, contains(lower(text), ' de ') AS b FROM benchmark)""")
def offline_citations(spark, d):
    """Citations by keyword for every benchmark item, as if it were a query."""
    out = knowledge.offline_citations(table(spark, d, "benchmark"), "item_id", "text", RULES, FALLBACK)
    return out.select("item_id", "url", "title", "confidence")


@query(f"""WITH $VIEWS, f AS (SELECT stream_id, timestamp_sec AS t FROM keyframes), b AS (SELECT DISTINCT stream_id, start_sec AS lo, start_sec + 60 AS hi FROM speech), a AS (SELECT stream_id, count(*) AS n FROM f GROUP BY 1),
m AS (SELECT stream_id, count(*) AS nb, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.stream_id = b.stream_id AND t BETWEEN lo AND hi)) AS met FROM b GROUP BY 1), x AS (SELECT *, floor(duration / 60)::BIGINT + 1 AS fixed FROM bounds)
SELECT stream_id AS run_id, fixed AS fixed_frames, coalesce(n, 0) AS analyzed, greatest(0, fixed - coalesce(n, 0)) AS frames_saved, round(100 * greatest(0, fixed - coalesce(n, 0)) / fixed, 2) AS reduction_pct, CASE WHEN nb IS NULL THEN 100.0 ELSE round(100 * met / nb, 2) END AS burst_coverage_pct FROM x LEFT JOIN a USING (stream_id) LEFT JOIN m USING (stream_id)""")
def sampling_runs(spark, d):
    """The report of a recorded sampling run per recording."""
    runs = V.bounds(V.chat(spark, d)).select(F.col("stream_id").alias("run_id"), F.col("duration").alias("duration_sec"), F.lit(60.0).alias("interval_sec"))
    frames = V.keyframes(spark, d).select(F.col("stream_id").alias("run_id"), F.col("timestamp_sec").alias("t"))
    bursts = V.speech(spark, d).select(F.col("stream_id").alias("run_id"), F.col("start_sec").alias("lo"), (F.col("start_sec") + 60).alias("hi"))
    return registry.sampling_report(runs, frames, bursts).select("run_id", "fixed_frames", "analyzed", "frames_saved", "reduction_pct", "burst_coverage_pct")


@query("""SELECT 'e' || event_id AS candidate_id, 'take ' || event_type AS title, round(20 + event_id % 40, 6)::DOUBLE AS duration_sec FROM events WHERE event_type = 'signup'""")
def package_files(spark, d):
    """Packages of signups written as JSON files, among files that are none, and listed."""
    e = V.events(spark, d).where("event_type = 'signup'")
    rows = e.select(F.concat(F.lit("e"), "event_id").alias("candidate_id"), F.col("t").alias("start_sec"), (F.col("t") + 20 + F.col("event_id") % 40).alias("end_sec"), F.lit("PASSED").alias("audit_status"), F.lit(50.0).alias("overall_virality_score"), F.concat(F.lit("take "), "event_type").alias("title"))
    folder = _folder(spark, "packages")
    production.write_packages(rows.coalesce(4), folder, 100)
    spark.createDataFrame([("not a package",), ('{"title": "no id"}',)], "value string").coalesce(1).write.mode("append").option("compression", "none").text(f"{folder}/odd.json")
    found = production.read_packages(spark, folder).unionByName(production.read_packages(spark, f"{folder}/odd.json", "*"))
    return found.select("candidate_id", "title", r6("duration_sec").alias("duration_sec"))


# ---- chains that met hardly any data in their first query --------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def unlabelled_documents(spark, d):
    """Documents that no label row knows."""
    return store.unknown(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("""WITH $VIEWS, n AS (SELECT count(*) AS n FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), p AS (SELECT label, list(m ORDER BY i) AS cv FROM c GROUP BY label),
q AS (SELECT stream_id, segment_id, speaker_label, vec_id, embedding::DOUBLE[] AS e FROM speech, n JOIN embeddings ON vec_id = segment_id % n.n), s AS (SELECT stream_id, segment_id, speaker_label, label, list_cosine_similarity(e, cv) AS sim FROM q CROSS JOIN p)
SELECT stream_id, segment_id, CASE WHEN round(sim, 9) >= 0.3 THEN 'creator_' || label ELSE speaker_label END AS speaker_label FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY sim DESC, label) AS r FROM s) WHERE r = 1""")
def voice_attribution(spark, d):
    """Every segment with an embedding, matched to the enrolled creators; known ones get the creator's label."""
    e = table(spark, d, "embeddings")
    n = e.count()
    said = V.speech(spark, d).withColumn("vec_id", F.pmod("segment_id", F.lit(n)))
    heard = said.join(e, "vec_id").select("segment_id", "embedding")
    known = knowledge.centroid_match(heard, knowledge.centroids(e, "label", "embedding"), "segment_id", "embedding").where(F.round("sim", 9) >= 0.3)
    named = known.select("segment_id", F.concat(F.lit("creator_"), F.col("centroid_id").cast("string")).alias("assigned"))
    return media.attributed(said.join(heard.select("segment_id"), "segment_id", "left_semi"), named, "segment_id").select("stream_id", "segment_id", "speaker_label")


@query("""WITH $VIEWS, f AS (SELECT stream_id, frame_index, timestamp_sec, scene_type, (frame_index % 10) / 20 AS a FROM keyframes WHERE scene_type = 'FULLSCREEN_CAM' OR frame_index % 3 = 0),
c AS (SELECT event_id, user_id % 8 AS stream_id, t AS lo, t + 3600 AS hi, value FROM ev WHERE event_type = 'signup'),
j AS (SELECT event_id, arg_min(CASE WHEN scene_type = 'FULLSCREEN_CAM' THEN [0.20, 0.10, 0.60, 0.80] ELSE [a, 0.1, 0.3, 0.4] END, struct_pack(t := timestamp_sec, i := frame_index)) AS b FROM c JOIN f ON f.stream_id = c.stream_id AND timestamp_sec BETWEEN lo AND hi GROUP BY 1)
SELECT event_id, round(coalesce(b[1], 0.65), 6) AS x, round(coalesce(b[2], 0.55), 6) AS y, round(coalesce(b[3], 0.35), 6) AS w, round(coalesce(b[4], 0.45), 6) AS h FROM c LEFT JOIN j USING (event_id)""")
def camera_boxes(spark, d):
    """The camera box of an hour after each signup: from the first frame that shows the camera alone or a face."""
    a = (F.col("frame_index") % 10) / 20
    face = F.struct(F.lit("Face").alias("label"), F.lit(0.9).alias("confidence"), F.array(F.lit(0.1), a, F.lit(0.5), a + 0.3).alias("box"))
    chair = F.struct(F.lit("chair").alias("label"), F.lit(0.5).alias("confidence"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("box"))
    frames = V.keyframes(spark, d).withColumn("detected_objects", F.when(F.col("frame_index") % 3 == 0, F.array(chair, face)).otherwise(F.array(chair)))
    c = V.events(spark, d).where("event_type = 'signup'").select("event_id", (F.col("user_id") % 8).alias("stream_id"), F.col("t").alias("lo"), (F.col("t") + 3600).alias("hi"), F.lit("HYPE").alias("emotion"), F.lit(1.0).alias("z"))
    p = production.cut_plans(c, frames, ["stream_id"], "event_id", "lo", "hi", "emotion", "z", 3600.0)
    return p.select("event_id", *[r6(F.col(f"facecam.{k}")).alias(k) for k in "xywh"])


def _register_bursts() -> None:
    from vodlens.plans.oracles import SLANG

    @query(f"""WITH RECURSIVE $VIEWS, {SLANG}, t AS (SELECT DISTINCT token AS term FROM burst UNION SELECT DISTINCT 'x' || token FROM burst),
o2 AS MATERIALIZED (SELECT term, list_distinct(list_transform(generate_series(1, greatest(1, length(term))), lambda i: ('^' || term || '$')[i:i + 2])) AS g, row_number() OVER (ORDER BY term) AS n FROM t),
r2 AS (SELECT 0::BIGINT AS n, []::STRUCT(l VARCHAR, g VARCHAR[])[] AS leads, NULL::VARCHAR AS leader UNION ALL
SELECT n, CASE WHEN found IS NULL THEN list_append(leads, struct_pack(l := term, g := g)) ELSE leads END, coalesce(found, term) FROM
(SELECT o2.n, o2.term, o2.g, r2.leads, list_filter(r2.leads, lambda x: len(list_intersect(x.g, o2.g))::DOUBLE / len(list_distinct(list_concat(x.g, o2.g))) >= 0.40)[1].l AS found FROM r2 JOIN o2 ON o2.n = r2.n + 1))
SELECT term, leader FROM r2 JOIN o2 USING (n)""")
    def slang_clusters(spark, d):
        """The terms of slang bursts and a variant of each, clustered by their letters: the end of the slang chain."""
        from vodlens.plans.catalog import slang_bursts

        terms = slang_bursts(spark, d).select(F.col("token").alias("term")).distinct()
        both = terms.unionByName(terms.select(F.concat(F.lit("x"), "term").alias("term"))).distinct().withColumn("k", F.lit(1))
        return media.novel_clusters(both, ["k"], "term").select("term", "leader")

    @query(f"""WITH RECURSIVE $VIEWS, {DENSE}, {BURSTS}, loud AS (SELECT stream_id, greatest(0.0, start_sec - 1) AS lo, end_sec + 3 AS hi FROM speech WHERE contains(transcript, 'loved')),
sp AS (SELECT stream_id, bucket_index * {HOUR} AS lo, bucket_index * {HOUR} + {HOUR} AS hi FROM zb UNION ALL SELECT * FROM loud),
hot AS MATERIALIZED (SELECT b.stream_id, duration, list(struct_pack(lo := lo, hi := hi)) FILTER (lo IS NOT NULL) AS spans FROM bounds b LEFT JOIN sp USING (stream_id) GROUP BY ALL),
steps AS (SELECT stream_id, 0.0::DOUBLE AS t FROM hot WHERE duration > 0 UNION ALL SELECT stream_id, t2 FROM (SELECT s.stream_id, duration, s.t + CASE WHEN len(list_filter(coalesce(spans, []), lambda x: s.t BETWEEN x.lo AND x.hi)) > 0 THEN 600 ELSE 6000 END AS t2 FROM steps s JOIN hot USING (stream_id)) WHERE t2 < duration),
al3 AS (SELECT DISTINCT stream_id, round(t, 3) AS t FROM (SELECT * FROM steps UNION ALL SELECT k.stream_id, timestamp_sec + 0.1 FROM keyframes k JOIN bounds USING (stream_id) WHERE scene_type = 'REACT_VIDEO' AND timestamp_sec >= 0 AND timestamp_sec < duration) JOIN bounds USING (stream_id) WHERE round(t, 3) <= duration),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS k FROM al3),
r AS (SELECT stream_id, k, t AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.stream_id, o.k, CASE WHEN o.t - r.last >= 0.15 THEN o.t ELSE r.last END, o.t - r.last >= 0.15 FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
SELECT stream_id, t AS timestamp_sec FROM r JOIN o USING (stream_id, k) WHERE kept""")
    def burst_sampling(spark, d):
        """Sampling times where chat bursts and the segments in which something is loved overlap."""
        b = temporal.z_bursts(_dense(spark, d), ["stream_id"]).select("stream_id", (F.col("bucket_index") * HOUR).alias("lo"), ((F.col("bucket_index") + 1) * HOUR).alias("hi"))
        said = V.speech(spark, d).where(F.contains("transcript", F.lit("loved"))).select("stream_id", F.greatest(F.lit(0.0), F.col("start_sec") - 1).alias("lo"), (F.col("end_sec") + 3).alias("hi"))
        cuts = V.keyframes(spark, d).where("scene_type = 'REACT_VIDEO'").select("stream_id", F.col("timestamp_sec").alias("cut"))
        return folds.sampling_plan(V.bounds(V.chat(spark, d)), b.unionByName(said), cuts, ["stream_id"], 600.0, 6000.0)


_register_bursts()


@query("""(SELECT 'search' AS page, 'p' || p_partkey AS vod_id, p_name AS title FROM part WHERE contains(lower(p_name), '1') OR contains('p' || p_partkey, '1') ORDER BY p_partkey LIMIT 40) UNION ALL
(SELECT 'status', 'p' || p_partkey, p_name FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 30 OFFSET 5) UNION ALL (SELECT 'unknown', 'p' || p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20)""")
def catalog_listing(spark, d):
    """Pages of a catalog: by search, by status, and by a status that nobody knows."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("vod_id"), F.col("p_name").alias("title"), F.lit("s").alias("streamer_id"), F.when(F.col("p_size") > 25, "QUEUED").otherwise("FAILED").alias("status"))
    page = lambda name, **o: store.listing(p, ["QUEUED", "FAILED"], [F.col("p_partkey")], "s", **o).select(F.lit(name).alias("page"), "vod_id", "title")
    out = page("search", status="failed", search="1", limit=40, offset=7)
    return out.unionByName(page("status", status="queued", limit=30, offset=5)).unionByName(page("unknown", status="lost", limit=20))


@query("""WITH f AS (SELECT page_id, 'x/' || CASE page_id % 4 WHEN 0 THEN 'a_proxy.mp4' WHEN 1 THEN 'shorts/b.mp4' WHEN 2 THEN 'my_short.json' ELSE 'c.bin' END AS path, length(html)::BIGINT AS length FROM pages)
SELECT sum(length)::BIGINT AS used_bytes, count(*) FILTER (page_id % 4 = 0) AS n_proxies, count(*) FILTER (page_id % 4 IN (1, 2)) AS n_shorts, round(100 * sum(length) / 1e9, 2) AS budget_usage_pct, CASE WHEN 100 * sum(length) / 1e9 >= 95 THEN 'HALT' WHEN 100 * sum(length) / 1e9 >= 90 THEN 'CRITICAL' WHEN 100 * sum(length) / 1e9 >= 75 THEN 'WARNING' ELSE 'NORMAL' END AS alert_level FROM f""")
def storage_usage(spark, d):
    """Pages as the files of a folder: bytes, classes and the level against a budget."""
    name = F.when(F.col("page_id") % 4 == 0, "a_proxy.mp4").when(F.col("page_id") % 4 == 1, "shorts/b.mp4").when(F.col("page_id") % 4 == 2, "my_short.json").otherwise("c.bin")
    files = table(spark, d, "pages").select(F.concat(F.lit("x/"), name).alias("path"), F.char_length("html").cast("long").alias("length"))
    return media.storage_usage(files, 1_000_000_000, 100 << 30)


@query("""WITH RECURSIVE s AS (SELECT 'c' || label AS streamer_id, -1 AS k0, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id < 10 UNION ALL SELECT 'c' || label, vec_id, embedding::DOUBLE[] FROM embeddings WHERE vec_id >= 10 AND vec_id % 3 = 0),
o AS MATERIALIZED (SELECT streamer_id, x, row_number() OVER (PARTITION BY streamer_id ORDER BY k0, x) AS k FROM s),
r AS (SELECT streamer_id, k, x AS c FROM o WHERE k = 1 UNION ALL SELECT streamer_id, k, list_transform(t, lambda z: z / CASE WHEN list_inner_product(t, t) > 0 THEN sqrt(list_inner_product(t, t)) ELSE 1 END) FROM
(SELECT o.streamer_id, o.k, list_transform(list_zip(r.c, o.x), lambda z: ((o.k - 1) * z[1] + z[2]) / o.k) AS t FROM r JOIN o ON o.streamer_id = r.streamer_id AND o.k = r.k + 1))
SELECT streamer_id, k AS sample_count, round(c[1], 6) AS c_first, round(c[64], 6) AS c_last FROM r QUALIFY k = max(k) OVER (PARTITION BY streamer_id)""")
def seeded_voiceprints(spark, d):
    """A roster's own embeddings seed the enrolment, later samples go on with it."""
    from vodlens.operators import feeders

    e = table(spark, d, "embeddings").withColumn("streamer_id", F.concat(F.lit("c"), "label"))
    out = feeders.seed_voiceprints(e.where("vec_id < 10").withColumnRenamed("embedding", "voiceprint_embedding"), e.where("vec_id >= 10 AND vec_id % 3 = 0").withColumnRenamed("vec_id", "sample_id"))
    return out.select("streamer_id", "sample_count", r6(F.get("centroid", F.lit(0))).alias("c_first"), r6(F.get("centroid", F.lit(63))).alias("c_last"))


def _register_talk() -> None:
    from vodlens.functions import lexicons as L
    from vodlens.operators import chat as chat_ops

    fill = ["so", "this", "game", "again", "tonight", "streamer", "kys"]
    known = [w for w in dict.fromkeys([*fill, *(w for own in L.INTENTS.values() for w in own), *L.HOSTILE_TOKENS, *L.BANTER_TOKENS, *L.ROASTS]) if " " not in w and w != "whaaat"]
    n, names = len(known), list(L.INTENTS)
    rows = ", ".join(f"('{w}')" for w in known)
    in_any = lambda own: f"len(list_intersect(list_filter(w, lambda x: length(x) > 1), [{', '.join(repr(x) for x in own)}])) > 0"
    votes = ", ".join(f"('{name}', {k}, [{', '.join(repr(w) for w in own)}])" for k, (name, own) in enumerate(L.INTENTS.items()))

    @query(f"""WITH l AS (SELECT list(w) AS ws FROM (VALUES {rows}) t(w)), m AS (SELECT event_id, [ws[event_id % {n} + 1], ws[(event_id // 7) % {n} + 1], ws[(event_id // 53) % {n} + 1]] AS w FROM events, l), i(intent, k, own) AS (VALUES {votes}),
v AS (SELECT event_id, intent, len(list_filter(w, lambda x: list_contains(own, x))) AS votes, list_position(list_transform(w, lambda x: list_contains(own, x)), true) * {len(names)} + k AS first FROM m, i),
b AS (SELECT event_id, arg_max(intent, struct_pack(v := votes, f := -first)) AS intent FROM v WHERE votes > 0 GROUP BY 1)
SELECT event_id, coalesce(intent, 'NEUTRAL') AS primary_intent, CASE WHEN list_contains(w, 'kys') THEN 'MALICIOUS_HARASSMENT' WHEN len(list_filter({list(L.ROASTS)!r}, lambda r: contains(array_to_string(w, ' '), r))) > 0 THEN 'COMMUNITY_ROAST'
WHEN {in_any(L.HOSTILE_TOKENS)} THEN 'BAD_FAITH_GRIEFING' WHEN {in_any(L.BANTER_TOKENS)} THEN 'GOOD_NATURED_BANTER' ELSE 'BENIGN_CHAT' END AS verdict FROM m LEFT JOIN b USING (event_id)""")
    def talk_verdicts(spark, d):
        """Messages of three words out of all lexicons: what each means to say, and whether it is banter or worse."""
        words = F.array(*map(F.lit, known))
        at = lambda step: F.get(words, (F.floor(F.col("event_id") / step) % n).cast("int"))
        said = table(spark, d, "events").select("event_id", F.concat_ws(" ", at(1), at(7), at(53)).alias("content"))
        intents = chat_ops.intents(said, ["event_id", "content"])
        return intents.select("event_id", "primary_intent", chat_ops.safety_verdict(F.col("content"))["verdict"].alias("verdict"))


_register_talk()
