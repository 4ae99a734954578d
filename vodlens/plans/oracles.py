"""DuckDB SQL for the queries whose rows need long statements: the matrix, folds, calibration and citations.

Folds are recursive statements that go from row to row; everything else is plain grouping and joining.
"""

from __future__ import annotations

from vodlens.functions import lexicons as L
from vodlens.operators import media
from vodlens.plans import views as V
from vodlens.plans.catalog import AGREE, BM25, CROSS, DAY, DENSE, DISSENT, HOUR, LEXICON, MENTIONS

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.replace("$VIEWS", V.SQL.strip())


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def similarity_tokens(c: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1))"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


# ---- the matrix ---------------------------------------------------------------------------------

MATRIX = f"""{DENSE}, lex(token, p) AS (VALUES {LEXICON}),
w AS (SELECT stream_id, floor(greatest(0.0, timestamp_offset - 4.5) / {HOUR})::BIGINT AS bucket_index, timestamp_offset AS a, message_id AS b, unnest(string_split(content, ' ')) AS token, generate_subscripts(string_split(content, ' '), 1) AS c FROM chat),
mood AS (SELECT stream_id, bucket_index, coalesce(sum(p) / nullif(count(p), 0), 0) AS sentiment FROM w LEFT JOIN lex USING (token) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, bucket_index ORDER BY n DESC, first) AS r FROM (SELECT stream_id, bucket_index, token, count(*) AS n, min(struct_pack(a := a, b := b, c := c)) AS first FROM w GROUP BY ALL)) WHERE r <= 5),
votes AS (SELECT stream_id, bucket_index, coalesce(sum(n) FILTER (token IN ({AGREE})), 0) AS ag, coalesce(sum(n) FILTER (token IN ({DISSENT})), 0) AS di,
  list(struct_pack("rank" := r, token := token, n := n) ORDER BY r) AS dominant_emotes FROM top GROUP BY ALL),
said AS (SELECT d.stream_id, bucket_index, bool_or(speaker_label = 'STREAMER') AS spoke, list_sort(list(DISTINCT speaker_label)) AS active_speakers,
  string_agg(transcript, ' ' ORDER BY segment_id, transcript) FILTER (speaker_label = 'STREAMER') AS streamer_transcript, string_agg(transcript, ' ' ORDER BY segment_id, transcript) FILTER (speaker_label <> 'STREAMER') AS external_audio_transcript
  FROM dense d JOIN speech s USING (stream_id) WHERE greatest(bucket_index * {HOUR}, start_sec) < least((bucket_index + 1) * {HOUR}, end_sec) GROUP BY ALL),
f AS (SELECT stream_id, floor(timestamp_sec / {HOUR})::BIGINT AS bucket_index, arg_max(struct_pack(s := scene_type, v := screen_summary, o := ocr_text_blocks), frame_index) AS fr FROM keyframes GROUP BY ALL),
j AS (SELECT d.*, coalesce(sentiment, 0) AS sentiment, coalesce(ag, 0) AS ag, coalesce(di, 0) AS di, dominant_emotes, coalesce(spoke, false) AS spoke, active_speakers, streamer_transcript, external_audio_transcript,
  last_value(fr IGNORE NULLS) OVER (PARTITION BY d.stream_id ORDER BY d.bucket_index ROWS UNBOUNDED PRECEDING) AS fr
  FROM dense d LEFT JOIN mood USING (stream_id, bucket_index) LEFT JOIN votes USING (stream_id, bucket_index) LEFT JOIN said USING (stream_id, bucket_index) LEFT JOIN f USING (stream_id, bucket_index)),
mat AS MATERIALIZED (SELECT stream_id, bucket_index, bucket_index * {HOUR} AS start_sec, bucket_index * {HOUR} + {HOUR} AS end_sec, coalesce(active_speakers, []) AS active_speakers, streamer_transcript, external_audio_transcript,
  coalesce(fr.s, 'UNKNOWN') AS active_scene_type, coalesce(fr.v, 'Unchanged scene') AS visual_description, coalesce(fr.o, []) AS screen_ocr, message_count AS chat_message_count, velocity AS chat_velocity_per_sec, dominant_emotes,
  sentiment AS chat_sentiment_polarity, velocity >= greatest(2.0, 2.2 * avg(velocity) OVER (PARTITION BY stream_id)) AS is_spike_moment,
  CASE WHEN spoke AND ag + di > 0 THEN (ag - di) / (ag + di) WHEN spoke AND message_count > 2 THEN sentiment END AS agreement_score FROM j)"""
LABEL = "CASE WHEN coalesce(agreement_score, 0) >= 0.33 THEN 'ALIGNED' WHEN coalesce(agreement_score, 0) <= -0.33 THEN 'AUDIENCE_REVOLT' ELSE 'DIVIDED' END"

oracle("fusion_highlights", f"WITH $VIEWS, {MATRIX} SELECT stream_id, bucket_index, greatest(0.0, start_sec - 4) AS clip_start, end_sec + 8 AS clip_end, CASE WHEN agreement_score IS NULL THEN 'NEUTRAL' ELSE {LABEL} END AS alignment_label FROM mat WHERE chat_message_count >= 3")
oracle("fusion_export", f"""WITH $VIEWS, {MATRIX} SELECT stream_id, bucket_index, start_sec, end_sec, array_to_string(active_speakers, ',') AS active_speakers, streamer_transcript, external_audio_transcript, active_scene_type, visual_description,
array_to_string(screen_ocr, ' | ') AS screen_ocr, chat_message_count, round(chat_velocity_per_sec, 9) AS chat_velocity_per_sec, coalesce(to_json(dominant_emotes)::VARCHAR, '[]') AS dominant_emotes, round(chat_sentiment_polarity, 9) AS chat_sentiment_polarity, is_spike_moment, round(coalesce(agreement_score, 0), 9) AS agreement_score FROM mat""")
oracle("training_triples", f"""WITH $VIEWS, {MATRIX} SELECT '{{"bucket_index":' || bucket_index || ',"visual_description":' || to_json(visual_description) || coalesce(',"streamer_transcript":' || to_json(streamer_transcript), '') || ',"chat_message_count":' || chat_message_count
|| ',"chat_sentiment_polarity":' || to_json(round(chat_sentiment_polarity, 6)) || ',"alignment":"' || {LABEL} || '"}}' AS value FROM mat WHERE coalesce(length(streamer_transcript), 0) > 0 OR chat_message_count >= 2""")
oracle("timeline_bundle", f"""WITH $VIEWS, {MATRIX}, s AS (SELECT stream_id, count(*) AS n_segments FROM speech GROUP BY stream_id),
m AS (SELECT stream_id, count(DISTINCT active_scene_type) AS n_scenes, count(*) FILTER (is_spike_moment) AS n_spikes, round(avg(agreement_score), 9) AS agreement, count(*) AS n_slices FROM mat GROUP BY stream_id) SELECT * FROM m LEFT JOIN s USING (stream_id)""")

CLOCK = "CASE WHEN start_sec < 3600 THEN printf('%02d:%02d', floor(start_sec / 60)::BIGINT, start_sec::BIGINT % 60) ELSE printf('%02d:%02d:%02d', floor(start_sec / 3600)::BIGINT, floor(start_sec / 60)::BIGINT % 60, start_sec::BIGINT % 60) END"
oracle("youtube_package", f"""WITH RECURSIVE $VIEWS, {MATRIX}, o AS MATERIALIZED (SELECT stream_id, bucket_index, start_sec, active_scene_type, row_number() OVER (PARTITION BY stream_id ORDER BY start_sec, bucket_index) AS k FROM mat WHERE chat_message_count >= 3),
r AS (SELECT stream_id, k, start_sec AS last, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.stream_id, o.k, CASE WHEN o.start_sec - r.last >= {DAY} THEN o.start_sec ELSE r.last END, o.start_sec - r.last >= {DAY} FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
SELECT stream_id, bucket_index, {CLOCK} || ' ' || array_to_string(list_transform(string_split(active_scene_type, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS chapter FROM r JOIN o USING (stream_id, k) WHERE kept""")


def scenes(rows: str, ts: str, scene: str, item: str, least: float) -> str:
    """Segment numbers: a new one where a known other scene begins after `least` seconds."""
    new = f"(o.scene <> r.now AND o.scene <> 'UNKNOWN' AND o.t - r.since >= {least})"
    return f"""o AS MATERIALIZED (SELECT stream_id, {ts} AS t, {scene} AS scene, {item} AS item, row_number() OVER (PARTITION BY stream_id ORDER BY {ts}, {item}) AS k FROM {rows}),
r AS (SELECT stream_id, k, 0 AS segment_id, scene AS now, t AS since FROM o WHERE k = 1 UNION ALL
SELECT o.stream_id, o.k, r.segment_id + {new}::INT, CASE WHEN {new} THEN o.scene ELSE r.now END, CASE WHEN {new} THEN o.t ELSE r.since END FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)"""


oracle("scene_segments", f"WITH RECURSIVE $VIEWS, {scenes('keyframes', 'timestamp_sec', 'scene_type', 'frame_index', DAY / 4)} SELECT stream_id, segment_id, item AS frame_index, scene AS scene_type FROM r JOIN o USING (stream_id, k)")
oracle("scene_chapters", f"""WITH RECURSIVE $VIEWS, {MATRIX}, {scenes('mat', 'start_sec', 'active_scene_type', 'bucket_index', DAY)},
g AS (SELECT stream_id, segment_id, item AS bucket_index FROM r JOIN o USING (stream_id, k)), x AS (SELECT * FROM g JOIN mat USING (stream_id, bucket_index)),
n AS (SELECT stream_id, segment_id, active_scene_type AS scene_type, count(*) AS n, min(bucket_index) AS first FROM x GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY stream_id, segment_id ORDER BY n DESC, first) AS i FROM n),
s AS (SELECT stream_id, segment_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, round(avg(chat_velocity_per_sec), 6) AS mean_velocity, (min(struct_pack(b := bucket_index, o := screen_ocr[1])) FILTER (len(screen_ocr) > 0)).o AS shown FROM x GROUP BY ALL)
SELECT stream_id, segment_id, scene_type, coalesce(shown, array_to_string(list_transform(string_split(scene_type, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ')) AS title, {CLOCK} AS label, start_sec, end_sec, mean_velocity FROM s JOIN c USING (stream_id, segment_id) WHERE i = 1""")

# ---- folds --------------------------------------------------------------------------------------


def greedy(rows: str, apart: float, cap: int | None = None) -> str:
    """Best first, at least `apart` from all kept; rows: stream_id, item, t, score."""
    free = f"(len(list_filter(r.kept, lambda x: abs(x - o.t) < {apart})) = 0{f' AND len(r.kept) < {cap}' if cap else ''})"
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, item) AS k FROM {rows}),
r AS (SELECT stream_id, k, [t] AS kept, 1 AS pick FROM o WHERE k = 1 UNION ALL
SELECT o.stream_id, o.k, CASE WHEN {free} THEN list_append(r.kept, o.t) ELSE r.kept END, CASE WHEN {free} THEN len(r.kept)::INT + 1 END FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)"""


oracle("greedy_nms", f"WITH RECURSIVE $VIEWS, e AS (SELECT user_id % 8 AS stream_id, event_id AS item, t, value AS score FROM ev), {greedy('e', DAY)} SELECT stream_id, item AS event_id, t, score AS value, pick FROM r JOIN o USING (stream_id, k) WHERE pick IS NOT NULL")
oracle("transcript_chunks", """WITH RECURSIVE $VIEWS, o AS MATERIALIZED (SELECT stream_id, start_sec AS s, end_sec AS e, transcript AS t, row_number() OVER (PARTITION BY stream_id ORDER BY start_sec, end_sec, transcript) AS k FROM speech WHERE trim(transcript) <> ''),
r AS (SELECT stream_id, k, 0 AS chunk_no, s AS begin FROM o WHERE k = 1 UNION ALL SELECT o.stream_id, o.k, r.chunk_no + (o.e - r.begin > 3600)::INT, CASE WHEN o.e - r.begin > 3600 THEN greatest(0.0, o.s - 60) ELSE r.begin END FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
SELECT stream_id, chunk_no, min(begin) AS start_sec, arg_max(e, k) AS end_sec, string_agg(t, ' ' ORDER BY k) AS text FROM r JOIN o USING (stream_id, k) GROUP BY stream_id, chunk_no""")
LINES = f"""wd AS (SELECT stream_id, start_sec, unnest({words('transcript')}) AS word, generate_subscripts({words('transcript')}, 1) - 1 AS i FROM speech),
tw AS (SELECT stream_id, start_sec + i * 0.4::DOUBLE AS s, start_sec + i * 0.4::DOUBLE + 0.3::DOUBLE AS e, word FROM wd),
pw AS (SELECT *, row_number() OVER w AS k, s - lag(e) OVER w > 0.8 AS pause FROM tw WINDOW w AS (PARTITION BY stream_id ORDER BY s, e)),
iw AS (SELECT *, sum(coalesce(pause, true)::INT) OVER (PARTITION BY stream_id ORDER BY k) AS island FROM pw),
lw AS (SELECT *, (row_number() OVER (PARTITION BY stream_id, island ORDER BY k) - 1) // 5 AS part FROM iw),
lines AS (SELECT stream_id, (row_number() OVER (PARTITION BY stream_id ORDER BY min(k)) - 1)::INT AS line_no, min(s) AS start_sec, arg_max(e, k) AS end_sec, string_agg(word, ' ' ORDER BY k) AS text FROM lw GROUP BY stream_id, island, part)"""
oracle("caption_lines", f"WITH $VIEWS, {LINES} SELECT * FROM lines")


def subtitle_clock(c: str) -> str:
    n = f"round({c} * 100)::BIGINT"
    return f"printf('%d:%02d:%02d.%02d', {n} // 360000, {n} // 6000 % 60, {n} // 100 % 60, {n} % 100)"


oracle("subtitle_events", f"WITH $VIEWS, {LINES} SELECT stream_id, line_no, 'Dialogue: 0,' || {subtitle_clock('start_sec')} || ',' || {subtitle_clock('end_sec')} || ',Default,,0,0,0,,' || text AS event FROM lines")


def leaders(author: str, least: int, similar: float, within: float, authors: int) -> str:
    """Clusters around seeds in time order; cl holds the seeds that found enough authors."""
    like = f"len(list_intersect(a.tok, b.tok))::DOUBLE / len(list_distinct(list_concat(a.tok, b.tok))) >= {similar}"
    return f"""lr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t, id) AS k FROM (SELECT stream_id, timestamp_offset AS t, message_id AS id, {author} AS author, {similarity_tokens('content')} AS tok FROM chat) WHERE len(tok) >= {least}),
near AS MATERIALIZED (SELECT a.stream_id, a.k, list(struct_pack(k := b.k, t := b.t, author := b.author) ORDER BY b.k) AS found FROM lr a JOIN lr b ON b.stream_id = a.stream_id AND b.k >= a.k AND b.t - a.t <= {within} AND {like} AND len(a.tok) > 0 GROUP BY ALL),
rc AS (SELECT DISTINCT stream_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::STRUCT(k BIGINT, t DOUBLE, author VARCHAR)[] AS members FROM lr UNION ALL
SELECT stream_id, k, list_filter(CASE WHEN ok THEN list_concat(used, list_transform(m, lambda x: x.k)) ELSE used END, lambda x: x > k), CASE WHEN ok THEN m END FROM
(SELECT *, len(list_distinct(list_transform(m, lambda x: x.author))) >= {authors} AS ok FROM (SELECT r.stream_id, r.k + 1 AS k, r.used,
  CASE WHEN list_contains(r.used, r.k + 1) THEN []::STRUCT(k BIGINT, t DOUBLE, author VARCHAR)[] ELSE list_filter(coalesce(n.found, []), lambda x: NOT list_contains(r.used, x.k)) END AS m
  FROM rc r JOIN lr o ON o.stream_id = r.stream_id AND o.k = r.k + 1 LEFT JOIN near n ON n.stream_id = r.stream_id AND n.k = r.k + 1))),
cl AS (SELECT rc.stream_id, lr.id AS seed, lr.t AS start_sec, list_max(list_transform(members, lambda x: x.t)) AS end_sec, len(list_distinct(list_transform(members, lambda x: x.author)))::INT AS n_authors, len(members)::INT AS n_rows
FROM rc JOIN lr USING (stream_id, k) WHERE members IS NOT NULL)"""


MEMES = leaders("author_name", 0, 0.65, HOUR, 3)
oracle("meme_bursts", f"WITH RECURSIVE $VIEWS, {MEMES} SELECT * FROM cl")
oracle("brigades", f"WITH RECURSIVE $VIEWS, {leaders('user_id::VARCHAR', 2, 0.70, 2 * HOUR, 4)} SELECT * FROM cl")
oracle("chatter_influence", f"""WITH RECURSIVE $VIEWS, {MEMES}, said AS (SELECT stream_id, start_sec AS s, end_sec AS e, {similarity_tokens('transcript')} AS st FROM speech WHERE speaker_label = 'STREAMER' AND trim(transcript) <> ''),
asked AS (SELECT stream_id, message_id, author_name, timestamp_offset + 3 AS m, {similarity_tokens('content')} AS mt FROM chat),
heard AS (SELECT DISTINCT a.stream_id, message_id, author_name FROM asked a JOIN said USING (stream_id) WHERE len(mt) >= 2 AND m BETWEEN s - 5 AND greatest(s, e) AND (len(list_intersect(mt, st)) >= 2 OR (len(mt) = 2 AND len(list_intersect(mt, st)) >= 1))),
a AS (SELECT author_name, count(*) AS total_messages FROM chat GROUP BY 1), b AS (SELECT author_name, count(*) AS origins FROM cl JOIN chat ON message_id = seed GROUP BY 1), c AS (SELECT author_name, count(*) AS responses FROM heard GROUP BY 1)
SELECT author_name, total_messages, coalesce(origins, 0) AS origins, coalesce(responses, 0) AS responses, round(0.5 * coalesce(origins, 0) + 0.4 * coalesce(responses, 0) + 0.1 * ln(1 + total_messages), 6) AS influence_score FROM a LEFT JOIN b USING (author_name) LEFT JOIN c USING (author_name)""")

SLANG = f"""st AS (SELECT stream_id, timestamp_offset AS t, author_name, unnest(list_distinct({words('lower(content)')})) AS token FROM chat),
sh AS (SELECT stream_id, token, author_name, unnest(generate_series(greatest(0, floor((t - 36000) / 18000)::BIGINT + 1), floor(t / 18000)::BIGINT)) AS h FROM st),
sw AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stream_id, token ORDER BY window_start) AS k FROM (SELECT stream_id, token, (h * 18000)::DOUBLE AS window_start, count(*) AS n, count(DISTINCT author_name) AS a FROM sh GROUP BY ALL) WHERE n >= 4 AND a >= 3),
sr AS (SELECT DISTINCT stream_id, token, 0::BIGINT AS k, 0.0::DOUBLE AS mean, 0.05::DOUBLE AS var, -1.0::DOUBLE AS z FROM sw UNION ALL
SELECT stream_id, token, k, m2, var + 0.25::DOUBLE * ((v - m2) * (v - m2) - var), (v - mean) / (sqrt(greatest(0.001::DOUBLE, var)) + 0.05::DOUBLE) FROM
(SELECT r.stream_id, r.token, w.k, w.n / 10.0::DOUBLE AS v, r.mean, r.var, r.mean + 0.25::DOUBLE * (w.n / 10.0::DOUBLE - r.mean) AS m2 FROM sr r JOIN sw w ON w.stream_id = r.stream_id AND w.token = r.token AND w.k = r.k + 1)),
burst AS (SELECT stream_id, token, window_start, n, z_score FROM (SELECT sw.*, round(z, 6) AS z_score, row_number() OVER (PARTITION BY stream_id, token ORDER BY k) AS i FROM sr JOIN sw USING (stream_id, token, k) WHERE z >= 1.0) WHERE i = 1)"""
oracle("slang_bursts", f"WITH RECURSIVE $VIEWS, {SLANG} SELECT * FROM burst")
INTENT_ROWS = ", ".join(f"('{w}', '{k}')" for k, own in L.INTENTS.items() for w in own)
WEIGHT_ROWS = ", ".join(f"('{k}', {v})" for k, v in L.INTENT_WEIGHTS.items())
oracle("adaptive_slang", rf"""WITH RECURSIVE $VIEWS, {SLANG}, intents(w, intent) AS (VALUES {INTENT_ROWS}), weights(intent, p) AS (VALUES {WEIGHT_ROWS}),
tk AS (SELECT b.token AS term, unnest(regexp_extract_all(lower(content), '([\p{{L}}\p{{M}}\p{{N}}_]+|<3)')) AS w FROM burst b JOIN chat c ON c.stream_id = b.stream_id AND timestamp_offset BETWEEN window_start AND window_start + 36002 AND contains(lower(content), b.token)),
v AS (SELECT term, sum(p) / count(*) AS valence FROM tk JOIN intents USING (w) JOIN weights USING (intent) WHERE w <> term GROUP BY term), p AS (SELECT token AS term, max(z_score) AS peak_z, sum(n)::BIGINT AS occurrences FROM burst GROUP BY token)
SELECT term, round(0.5 + least(0.35, peak_z * 0.05), 6) AS confidence, round(coalesce(valence, 0), 6) AS valence, occurrences, round(peak_z, 6) AS peak_z FROM p LEFT JOIN v USING (term)""")

BURSTS = f"""zs AS (SELECT *, avg(message_count) OVER w AS m, stddev_pop(message_count) OVER w AS sd FROM dense WINDOW w AS (PARTITION BY stream_id)),
zb AS (SELECT stream_id, bucket_index, CASE WHEN sd > 0 THEN (message_count - m) / sd ELSE 0 END AS z FROM zs WHERE message_count > 0 AND (CASE WHEN sd > 0 THEN (message_count - m) / sd ELSE 0 END >= 2.5 OR message_count >= 3 * m))"""
SAMPLES = f"""{DENSE}, {BURSTS}, hot AS MATERIALIZED (SELECT stream_id, duration, list(bucket_index * {HOUR}) FILTER (bucket_index IS NOT NULL) AS lows FROM bounds LEFT JOIN zb USING (stream_id) GROUP BY ALL),
steps AS (SELECT stream_id, 0.0::DOUBLE AS t FROM hot WHERE duration > 0 UNION ALL SELECT stream_id, t2 FROM (SELECT s.stream_id, duration, s.t + CASE WHEN len(list_filter(coalesce(lows, []), lambda x: s.t BETWEEN x AND x + {HOUR})) > 0 THEN 300 ELSE 3000 END AS t2 FROM steps s JOIN hot USING (stream_id)) WHERE t2 < duration)"""
oracle("sampling_times", f"WITH RECURSIVE $VIEWS, {SAMPLES} SELECT stream_id, round(t, 3) AS timestamp_sec FROM steps")
oracle("sampling_savings", f"""WITH RECURSIVE $VIEWS, {SAMPLES}, n AS (SELECT stream_id, count(*) AS n_actual FROM steps GROUP BY stream_id), x AS (SELECT stream_id, coalesce(n_actual, 0) AS n_actual, floor(duration / 300)::BIGINT + 1 AS n_fixed FROM bounds LEFT JOIN n USING (stream_id))
SELECT stream_id, n_actual, n_fixed, round(100 * (n_fixed - n_actual) / n_fixed, 6) AS reduction_pct, round(greatest(0, n_fixed - n_actual) * 0.08::DOUBLE, 6) AS saved_sec FROM x""")

# ---- lags ---------------------------------------------------------------------------------------


def lags(rows: str, keys: str, low: int, high: int) -> str:
    """The best lag of each key: rows hold keys, bin, a, b."""
    on = " AND ".join(f"y.{k.strip()} = x.{k.strip()}" for k in keys.split(","))
    unit = lambda c: f"CASE WHEN stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END AS {c}"
    mine = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    shifted = f"lx AS MATERIALIZED (SELECT {keys}, lag, bin + lag AS at, a FROM lz CROSS JOIN generate_series({low}, {high}) g(lag) WHERE a IS NOT NULL)"
    return f"""lz AS MATERIALIZED (SELECT {keys}, bin, {unit('a')}, {unit('b')} FROM {rows} WINDOW w AS (PARTITION BY {keys})),
{shifted}, ly AS MATERIALIZED (SELECT {keys}, bin AS at, b FROM lz WHERE b IS NOT NULL),
lc AS (SELECT {mine}, lag, sum(x.a * y.b) AS score, count(*) AS n_bins FROM lx x JOIN ly y ON {on} AND y.at = x.at GROUP BY ALL),
lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, lag) AS i FROM lc) WHERE i = 1)"""


oracle("correlation_offset", f"""WITH $VIEWS, h AS (SELECT user_id % 8 AS k, floor(t / {HOUR})::BIGINT AS bin, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'error') AS b FROM ev GROUP BY ALL),
{lags('h', 'k', -12, 12)} SELECT k, lag * {HOUR} AS offset_sec, round(greatest(0, least(1, score / n_bins)), 6) AS confidence FROM lb""")
WEIGHT = "CASE WHEN speaker_label = 'STREAMER' THEN 2.0 ELSE 1.0 END"
GOOD = "coalesce(n, 0) >= 10 AND duration > 10 AND lag IS NOT NULL AND score > -1 AND n_bins > 10"
oracle("latency_calibration", f"""WITH $VIEWS, sa AS (SELECT stream_id, unnest(generate_series(floor(start_sec / 60)::BIGINT, greatest(ceil(end_sec / 60)::BIGINT - 1, floor(start_sec / 60)::BIGINT))) AS bin, {WEIGHT} AS wt FROM speech WHERE end_sec > start_sec),
a AS (SELECT stream_id, bin, max(wt)::DOUBLE AS a FROM sa GROUP BY ALL), b AS (SELECT stream_id, floor(timestamp_offset / 60)::BIGINT AS bin, count(*)::DOUBLE AS b FROM chat GROUP BY ALL),
sp AS (SELECT stream_id, unnest(generate_series(0, floor(duration / 60)::BIGINT)) AS bin FROM bounds), h AS (SELECT stream_id, bin, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM sp LEFT JOIN a USING (stream_id, bin) LEFT JOIN b USING (stream_id, bin)),
{lags('h', 'stream_id', 2, 20)}, n AS (SELECT stream_id, count(*) AS n FROM chat GROUP BY 1)
SELECT stream_id, CASE WHEN {GOOD} THEN lag * 60.0 ELSE 4.5 END::DOUBLE AS latency_sec FROM bounds LEFT JOIN n USING (stream_id) LEFT JOIN lb USING (stream_id)""")
HOPS = f"unnest(generate_series(greatest(0, floor(({{0}} - {10 * DAY}) / {5 * DAY})::BIGINT + 1), floor({{0}} / {5 * DAY})::BIGINT))"
oracle("rolling_latency", f"""WITH $VIEWS, cw AS (SELECT stream_id, h * {5 * DAY} AS window_start, timestamp_offset - h * {5 * DAY} AS t FROM (SELECT *, {HOPS.format('timestamp_offset')} AS h FROM chat)),
sw AS (SELECT stream_id, h * {5 * DAY} AS window_start, start_sec - h * {5 * DAY} AS s, end_sec - h * {5 * DAY} AS e, {WEIGHT} AS wt FROM (SELECT *, {HOPS.format('start_sec')} AS h FROM speech)),
sa AS (SELECT stream_id, window_start, unnest(generate_series(floor(s / {HOUR})::BIGINT, greatest(ceil(e / {HOUR})::BIGINT - 1, floor(s / {HOUR})::BIGINT))) AS bin, wt FROM sw WHERE e > s), a AS (SELECT stream_id, window_start, bin, max(wt)::DOUBLE AS a FROM sa GROUP BY ALL),
b AS (SELECT stream_id, window_start, floor(t / {HOUR})::BIGINT AS bin, count(*)::DOUBLE AS b FROM cw GROUP BY ALL), bd AS (SELECT DISTINCT stream_id, window_start, {10 * DAY} AS duration FROM cw),
sp AS (SELECT stream_id, window_start, unnest(generate_series(0, {int(10 * 24)})) AS bin FROM bd), h AS (SELECT stream_id, window_start, bin, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM sp LEFT JOIN a USING (stream_id, window_start, bin) LEFT JOIN b USING (stream_id, window_start, bin)),
{lags('h', 'stream_id, window_start', 1, 9)}, n AS (SELECT stream_id, window_start, count(*) AS n FROM cw GROUP BY ALL)
SELECT stream_id, window_start, CASE WHEN {GOOD} THEN lag * {HOUR} ELSE 4.5 END::DOUBLE AS latency_sec FROM bd LEFT JOIN n USING (stream_id, window_start) LEFT JOIN lb USING (stream_id, window_start)""")

# ---- co-streams ---------------------------------------------------------------------------------

TIMELINE = f"""clex(token, p) AS (VALUES {CROSS}), al AS (SELECT *, timestamp_offset - CASE channel_id WHEN 1 THEN 2.5 WHEN 2 THEN -1.0 ELSE 0 END AS u FROM chat),
ms AS (SELECT message_id, coalesce(avg(p), 0) AS s FROM (SELECT message_id, unnest(string_split(lower(content), ' ')) AS token FROM chat) LEFT JOIN clex USING (token) GROUP BY message_id),
bk AS (SELECT stream_id, platform, floor((u - min(u) OVER (PARTITION BY stream_id)) / {DAY})::BIGINT AS bucket_index, s FROM al JOIN ms USING (message_id)), pf AS (SELECT stream_id, bucket_index, platform, avg(s) AS m, count(*) AS n FROM bk GROUP BY ALL),
tl AS (SELECT stream_id, bucket_index, max(m) - min(m) AS spread, greatest(0, least(1, 1 - (max(m) - min(m)) / 2)) AS agreement, max(m) - min(m) >= 0.75 AS diverges FROM pf GROUP BY ALL HAVING sum(n) >= 3)"""
oracle("agreement_summary", f"WITH $VIEWS, {TIMELINE} SELECT stream_id, round(avg(agreement), 6) AS mean_agreement, count(*) FILTER (diverges) AS n_divergent, count(*) AS n_points FROM tl GROUP BY stream_id")
oracle("multi_angle_candidates", f"""WITH $VIEWS, {TIMELINE}, nr AS (SELECT tl.stream_id, bucket_index, count(u) AS n_messages FROM tl LEFT JOIN al ON al.stream_id = tl.stream_id AND u BETWEEN bucket_index * {DAY} - {HOUR / 2} AND bucket_index * {DAY} + {HOUR / 2} GROUP BY ALL)
SELECT stream_id, bucket_index, n_messages, round(least(99, greatest(10, 40 * abs(spread) + least(30, 1.5 * n_messages) + CASE WHEN diverges THEN 20 ELSE 0 END + CASE WHEN agreement >= 0.85 THEN 15 ELSE 0 END)), 6)::DOUBLE AS virality_score FROM tl JOIN nr USING (stream_id, bucket_index)""")

# ---- knowledge, screen and citations -------------------------------------------------------------

ENTITY_CASES = ", ".join(f"CASE WHEN regexp_matches(low, '{'|'.join(own)}') THEN struct_pack(entity := '{name}', category := '{kind}') END" for kind, group in L.ENTITIES.items() for name, own in group.items())
oracle("entity_counts", f"""WITH $VIEWS, t AS (SELECT lower(text) AS low, source FROM documents UNION ALL SELECT lower(content || ' lol patch'), 'chat' FROM chat), x AS (SELECT source, unnest(list_filter([{ENTITY_CASES}], lambda x: x IS NOT NULL)) AS e FROM t)
SELECT e.entity AS entity, e.category AS category, sum(CASE WHEN source = 'src0' THEN 2.0 ELSE 1.0 END)::DOUBLE AS weighted, count(*) AS n_texts FROM x GROUP BY ALL""")
oracle("hash_embeddings", "SELECT conv_id * 1000 + turn AS chunk_id, CASE WHEN regexp_matches(lower(text), '[a-z0-9_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM conversations")
CITED = f"""{BM25}, sc AS (SELECT doc_id, round(score, 6) AS score, source, lang, text FROM bm JOIN documents USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, doc_id) AS i FROM sc),
ci AS (SELECT source, lang, doc_id, score, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS quote FROM rk WHERE i <= CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 1 WHEN 'de' THEN 1 ELSE 0 END ORDER BY score DESC, doc_id LIMIT 5)"""
oracle("rag_evidence", f"WITH {CITED} SELECT * FROM ci")
oracle("rag_answer", f"WITH {CITED} SELECT string_agg('- [' || source || '] ' || quote, chr(10) ORDER BY score DESC, doc_id) AS answer, count(*) AS n_citations FROM ci")
KNOWN = " OR ".join(f"contains(lower(m), '{s}')" for s in L.SITES)
oracle("screen_addresses", rf"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) || ' see https://x.com/a' AS block FROM documents), u AS (SELECT doc_id, list_filter(regexp_extract_all(block, '{media.ADDRESS}', 1), lambda m: {KNOWN})[1] AS url FROM b)
SELECT DISTINCT doc_id, url, CASE WHEN url IS NOT NULL THEN regexp_extract(lower(url), '([a-z0-9-]+\.[a-z]{{2,}})', 1) END AS domain FROM u""")
oracle("screen_cards", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l), h AS (SELECT *, regexp_extract(line, '{media.HANDLE}', 1) AS handle FROM p),
n AS (SELECT *, coalesce(nullif(trim(replace(line, handle, '')), ''), CASE WHEN i > 1 THEN lines[i - 1] END) AS name FROM h WHERE handle <> '')
SELECT doc_id, 0 AS block_no, (i - 1)::INT AS line_no, handle, coalesce(name, regexp_replace(handle, '^@+', '')) AS author_name, coalesce(nullif(trim(array_to_string(list_filter(lines, lambda x, k: k <> i AND (name IS NULL OR x <> name)), ' ')), ''), line) AS post_text FROM n""")
oracle("read_along", f"""WITH $VIEWS, s AS (SELECT stream_id, segment_id, start_sec, end_sec, {similarity_tokens('transcript')} AS tok, len({words('transcript')}) AS n FROM speech),
x AS (SELECT a.stream_id, a.segment_id, b.segment_id AS frame_index, len(list_intersect(a.tok, b.tok)) / len(a.tok) AS score, a.n * 60.0 / greatest(0.2, a.end_sec - a.start_sec) AS wpm FROM s a JOIN s b ON b.stream_id = a.stream_id AND b.start_sec BETWEEN a.start_sec - 2 AND a.start_sec + 2 WHERE len(a.tok) > 0 AND len(b.tok) > 0)
SELECT stream_id, segment_id, frame_index, round(score, 6) AS score, round(wpm, 6) AS wpm FROM x WHERE score >= 0.55""")
oracle("sponsor_contract_audit", f"""WITH $VIEWS, {MENTIONS}, lex(token, p) AS (VALUES {LEXICON}),
air AS (SELECT stream_id, min(start_sec) AS lo, max(end_sec) AS hi, sum(end_sec - start_sec) AS airtime_sec, sum(CASE WHEN n_ocr > 0 THEN end_sec - start_sec ELSE 0.0 END) AS logo_sec FROM seg GROUP BY 1),
sd AS (SELECT a.stream_id, bool_or(contains(lower(transcript), 'nordvpn')) AS k0, bool_or(contains(lower(transcript), 'story')) AS k1, bool_or(contains(lower(transcript), 'lucky')) AS k2 FROM air a JOIN speech s ON s.stream_id = a.stream_id AND s.end_sec >= lo AND s.start_sec <= hi GROUP BY 1),
ml AS (SELECT message_id, coalesce(sum(p) / nullif(count(p), 0), 0) AS s FROM (SELECT message_id, unnest(string_split(content, ' ')) AS token FROM chat) LEFT JOIN lex USING (token) GROUP BY 1),
md AS (SELECT a.stream_id, count(*) AS n, count(*) FILTER (s > 0.15 OR {' OR '.join(f"contains(lower(content), '{w}')" for w in L.POSITIVE_CHAT)}) AS np, count(*) FILTER ({' OR '.join(f"contains(lower(content), '{w}')" for w in L.PURCHASE_TRIGGERS)}) AS n_intent FROM air a JOIN chat c ON c.stream_id = a.stream_id AND timestamp_offset BETWEEN lo AND hi JOIN ml USING (message_id) GROUP BY 1),
x AS (SELECT stream_id, airtime_sec, logo_sec, (coalesce(k0, false)::INT + coalesce(k1, false)::INT) * 100.0 / 2 AS keyword_pct, coalesce(k2, false) AS promo_mentioned, CASE WHEN coalesce(n, 0) > 0 THEN np * 100.0 / n ELSE 75.0 END AS positive_pct, coalesce(n_intent, 0) AS n_intent, coalesce(n, 0) = 0 AS is_estimated FROM air LEFT JOIN sd USING (stream_id) LEFT JOIN md USING (stream_id))
SELECT stream_id, round(airtime_sec, 6) AS airtime_sec, round(logo_sec, 6) AS logo_sec, keyword_pct::DOUBLE AS keyword_pct, promo_mentioned, round(positive_pct, 6)::DOUBLE AS positive_pct, n_intent, round(airtime_sec * 15 * (1 + positive_pct / 100) + n_intent * 25, 6) AS earned_value, is_estimated, keyword_pct >= 80 AND promo_mentioned AND airtime_sec >= 480 AS compliance_passed FROM x""")
oracle("novel_clusters", """WITH RECURSIVE t AS (SELECT DISTINCT conv_id AS key, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM conversations),
o AS MATERIALIZED (SELECT key, term, list_distinct(list_transform(generate_series(1, greatest(1, length(term))), lambda i: ('^' || term || '$')[i:i + 2])) AS g, row_number() OVER (PARTITION BY key ORDER BY term) AS n FROM t),
r AS (SELECT DISTINCT key, 0::BIGINT AS n, []::STRUCT(l VARCHAR, g VARCHAR[])[] AS leads, NULL::VARCHAR AS leader FROM o UNION ALL
SELECT key, n, CASE WHEN found IS NULL THEN list_append(leads, struct_pack(l := term, g := g)) ELSE leads END, coalesce(found, term) FROM
(SELECT o.key, o.n, o.term, o.g, r.leads, list_filter(r.leads, lambda x: len(list_intersect(x.g, o.g))::DOUBLE / len(list_distinct(list_concat(x.g, o.g))) >= 0.40)[1].l AS found FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1))
SELECT key AS k, term, leader FROM r JOIN o USING (key, n)""")
