"""Screen, speech and sampling operators, latency calibration and slang context."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.functions import lexicons as L
from vodlens.operators.folds import folded
from vodlens.operators.islands import merge_intervals
from vodlens.operators.temporal import best_lag, range_join

#: What a handle and an address look like on screen.
HANDLE = r"(@[A-Za-z0-9_]{1,15})"
ADDRESS = r"((?:https?://)?(?:www\.)?[A-Za-z0-9.-]+\.[a-z]{2,}(?:/[^\s]*)?)"
HYPE_WORDS = ["insane", "clutch", "no way", "oh my god", "let's go", "holy", "wow"]


def screen_cards(frames: DataFrame, keep: list[str], blocks: str = "ocr_text_blocks") -> DataFrame:
    """A card for each on-screen line with a handle: handle, name (rest of the line, else the line before) and text."""
    rows = frames.select(*keep, F.posexplode(blocks).alias("block_no", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    placed = rows.select(*keep, "block_no", lines.alias("lines"), F.posexplode(lines).alias("line_no", "line"))
    handle = F.regexp_extract("line", HANDLE, 1)
    same = F.trim(F.replace(F.col("line"), handle, F.lit("")))
    name = F.coalesce(F.nullif(same, F.lit("")), F.when(F.col("line_no") > 0, F.get("lines", F.col("line_no") - 1)))
    cards = placed.where(F.regexp_extract("line", HANDLE, 1) != "").withColumn("handle", handle).withColumn("name", name)
    body = F.array_join(F.filter("lines", lambda x, i: (i != F.col("line_no")) & (F.col("name").isNull() | (x != F.col("name")))), " ")
    text = F.coalesce(F.nullif(F.trim(body), F.lit("")), F.col("line"))
    return cards.select(*keep, "block_no", "line_no", "handle", F.coalesce("name", F.regexp_replace("handle", "^@+", "")).alias("author_name"), text.alias("post_text"))


def screen_address(block: Column) -> Column:
    """The first address of a known site in a text, with its domain, as a struct."""
    found = F.regexp_extract_all(block, F.lit(ADDRESS), F.lit(1))
    known = F.filter(found, lambda m: C.any_contained(F.lower(m), L.SITES))
    url = F.get(known, F.lit(0))
    return F.when(url.isNotNull(), F.struct(url.alias("url"), F.regexp_extract(F.lower(url), r"([a-z0-9-]+\.[a-z]{2,})", 1).alias("domain")))


def is_killfeed(block: Column) -> Column:
    return C.any_contained(F.lower(block), L.KILLFEED)


def read_along(speech: DataFrame, frames: DataFrame, keys: list[str], window: float = 2.0, least: float = 0.55) -> DataFrame:
    """Segments whose words stand on screen within `window` seconds of their start, with the share and words per minute."""
    said = speech.select(*keys, "segment_id", "start_sec", "end_sec", C.similarity_tokens(F.col("transcript")).alias("s"), F.size(C.words(F.col("transcript"))).alias("n"))
    shown = frames.select(*keys, "frame_index", F.col("timestamp_sec").alias("t"), C.similarity_tokens(F.array_join("ocr_text_blocks", " ")).alias("o")).where(F.size("o") > 0)
    near = range_join(shown, said.withColumn("lo", F.col("start_sec") - window).withColumn("hi", F.col("start_sec") + window), keys, "t", "lo", "hi", 2 * window)
    share = F.size(F.array_intersect("s", "o")) / F.size("s")
    scored = near.where(F.size("s") > 0).withColumn("score", share).where(F.col("score") >= least)
    return scored.select(*keys, "segment_id", "frame_index", "score", (F.col("n") * 60.0 / F.greatest(F.lit(0.2), F.col("end_sec") - F.col("start_sec"))).alias("wpm"))


def speech_bursts(speech: DataFrame, keys: list[str], duration: Column | float, rate: float = 3.5) -> DataFrame:
    """Merged intervals around fast, hyped or exclaiming speech."""
    n = F.size(C.words(F.col("transcript"))) / F.greatest(F.lit(0.2), F.col("end_sec") - F.col("start_sec"))
    hot = (n >= rate) | C.any_contained(F.lower("transcript"), HYPE_WORDS) | F.contains("transcript", F.lit("!"))
    end = F.lit(float(duration)) if isinstance(duration, (int, float)) else duration
    rows = speech.where(hot).select(*keys, "segment_id", F.greatest(F.lit(0.0), F.col("start_sec") - 1).alias("lo"), F.least(end, F.col("end_sec") + 3).alias("hi"))
    return merge_intervals(rows, keys, "lo", "hi", ["lo", "segment_id"])


def burst_coverage(bursts: DataFrame, frames: DataFrame, keys: list[str], widest: float) -> DataFrame:
    """Bursts (keys, burst_id, lo, hi) per key and how many hold a frame."""
    hit = range_join(frames.select(*keys, F.col("timestamp_sec").alias("t")), bursts, keys, "t", "lo", "hi", widest).select(*keys, "burst_id").distinct().withColumn("covered", F.lit(1))
    j = bursts.join(hit, [*keys, "burst_id"], "left")
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bursts"), F.sum(F.coalesce("covered", F.lit(0))).cast("long").alias("n_covered"))


def speaker_at(segments: DataFrame, turns: DataFrame, keys: list[str], bin_size: float = 60.0, default: str = "SPEAKER_00") -> DataFrame:
    """The speaker of the first turn that holds each segment's midpoint."""
    mid = segments.withColumn("mid", (F.col("start_sec") + F.col("end_sec")) / 2)
    spans = turns.select(*keys, F.col("turn_start").alias("lo"), F.col("turn_end").alias("hi"), "speaker", "turn_id")
    found = range_join(mid.select(*keys, "segment_id", "mid"), spans, keys, "mid", "lo", "hi", bin_size)
    best = found.groupBy(*keys, "segment_id").agg(F.min_by("speaker", F.struct("lo", "turn_id")).alias("speaker"))
    return segments.join(best, [*keys, "segment_id"], "left").withColumn("speaker", F.coalesce("speaker", F.lit(default)))


def attributed(segments: DataFrame, known: DataFrame, item: str) -> DataFrame:
    """Segments with the label assigned to their embedding; without one they keep their own."""
    return segments.join(known.select(item, "assigned"), item, "left").withColumn("speaker_label", F.coalesce("assigned", "speaker_label")).drop("assigned")


def loud_segments(rows: DataFrame, keys: list[str], rms: str, factor: float = 0.9) -> DataFrame:
    """The streamer is where a segment is at least `factor` of its stream's mean loudness."""
    return rows.withColumn("speaker_label", F.when(F.col(rms) >= factor * F.avg(rms).over(Window.partitionBy(*keys)), "STREAMER").otherwise("EXTERNAL_VIDEO"))


def calibrate_latency(speech: DataFrame, chat: DataFrame, bounds: DataFrame, keys: list[str], step: float = 0.5, low: float = 2.0, high: float = 9.0, default: float = 4.5, least: int = 10) -> DataFrame:
    """The chat's delay behind the speech: the lag of the best correlation of their densities, else the default.

    Speech weighs 2 for the streamer and 1 for others in each bin that it overlaps; chat counts per bin.
    """
    from vodlens.operators.temporal import overlap_buckets, spine

    weight = F.when(F.col("speaker_label") == "STREAMER", 2.0).otherwise(1.0)
    a = overlap_buckets(speech, "start_sec", "end_sec", step).groupBy(*keys, F.col("bucket_index").cast("long").alias("bucket_index")).agg(F.max(weight).alias("a"))
    b = chat.groupBy(*keys, F.floor(F.col("timestamp_offset") / step).cast("long").alias("bucket_index")).agg(F.count(F.lit(1)).cast("double").alias("b"))
    dense = spine(bounds, keys, step).join(a, [*keys, "bucket_index"], "left").join(b, [*keys, "bucket_index"], "left").fillna(0.0, ["a", "b"])
    lag = best_lag(dense.select(*keys, F.col("bucket_index").alias("bin"), "a", "b"), keys, int(low / step), int(high / step))
    n = chat.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    j = bounds.select(*keys, "duration").join(n, keys, "left").join(lag, keys, "left")
    good = (F.coalesce("n", F.lit(0)) >= least) & (F.col("duration") > 10) & F.col("lag").isNotNull() & (F.col("score") > -1) & (F.col("n_bins") > 10)
    return j.select(*keys, F.when(good, F.col("lag") * step).otherwise(F.lit(default)).alias("latency_sec"))


def rolling_latency(speech: DataFrame, chat: DataFrame, keys: list[str], duration: Column, window: float = 300.0, hop: float = 150.0, **options) -> DataFrame:
    """calibrate_latency in sliding windows, each on its own clock."""
    from vodlens.operators.temporal import sliding

    def own(rows: DataFrame, *cols: str) -> DataFrame:
        out = sliding(rows, F.col(cols[0]), window, hop)
        return out.withColumns({c: F.col(c) - F.col("window_start") for c in cols})

    c, s = own(chat, "timestamp_offset"), own(speech, "start_sec", "end_sec")
    b = c.select(*keys, "window_start").distinct().withColumn("duration", F.lit(window))
    return calibrate_latency(s, c, b, [*keys, "window_start"], **options)


def sampling_savings(actual: DataFrame, bounds: DataFrame, keys: list[str], fixed_step: float, frame_sec: float = 0.08) -> DataFrame:
    """Frames of the sampling plan against those of a fixed step."""
    n = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_actual"))
    j = bounds.join(n, keys, "left").fillna(0, ["n_actual"]).withColumn("n_fixed", F.floor(F.col("duration") / fixed_step) + 1)
    saved = F.col("n_fixed") - F.col("n_actual")
    return j.select(*keys, "n_actual", "n_fixed", (100 * saved / F.col("n_fixed")).alias("reduction_pct"), (F.greatest(F.lit(0), saved) * frame_sec).alias("saved_sec"))


def slang_context(candidates: DataFrame, chat: DataFrame, keys: list[str], widest: float) -> DataFrame:
    """Votes of the known words beside each candidate term, in its window and two seconds after.

    A message counts once for every window of a term that it is in; how many there are comes from an
    ordered scan over the windows' ends, not from pairs. Messages of equal text are counted together.
    """
    from vodlens.operators import scans

    words = chat.where("timestamp_offset IS NOT NULL").select(*keys, F.col("timestamp_offset").alias("t"), F.lower("content").alias("low"))
    spans = candidates.select(*keys, "term", F.col("window_start").alias("lo"), (F.col("window_end") + 2).alias("hi")).where("hi >= lo AND term IS NOT NULL")
    bins = F.explode(F.sequence(F.floor(F.col("lo") / widest), F.floor(F.col("hi") / widest)))
    there = spans.select(*keys, "term", bins.alias("s_bin")).distinct()
    asked = words.withColumn("s_bin", F.floor(F.col("t") / widest)).join(there, [*keys, "s_bin"]).where(F.contains("low", F.col("term")))
    row = lambda t, side, n, low: [*keys, "term", F.col(t).cast("double").alias("t"), F.lit(side).alias("side"), F.lit(n).cast("long").alias("ends"), low.alias("low")]
    none = F.lit(None).cast("string")
    edges = spans.select(*row("lo", 0, 1, none)).unionByName(spans.select(*row("hi", 2, -1, none)))
    counted = scans.scan(asked.select(*row("t", 1, 0, F.col("low"))).unionByName(edges), [*keys, "term"], "t", ["t", "side"], 24 * widest, n=scans.Scan("sum", F.col("ends")))
    texts = counted.where("side = 1 AND n > 0").groupBy(*keys, "term", "low").agg(F.sum("n").alias("n"))
    tokens = texts.select(*keys, "term", "n", F.explode(F.regexp_extract_all("low", F.lit(r"(?U)(\w+|<3)"), F.lit(1))).alias("w")).where("w <> term")
    hit = F.array_compact(F.array(*[F.when(F.col("w").isin(*own), F.lit(name)) for name, own in L.INTENTS.items()]))
    return tokens.select(*keys, "term", "n", F.explode(hit).alias("intent")).groupBy(*keys, "term", "intent").agg(F.sum("n").alias("votes"))


def novel_clusters(terms: DataFrame, keys: list[str], term: str, least: float = 0.40) -> DataFrame:
    """Terms joined to the first cluster whose first term shares enough character trigrams (padded with ^ and $).

    A term is compared with the clusters that share a trigram, not with all.
    """
    kinds = {f.name: f.dataType.simpleString() for f in terms.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{term} string, leader string"])

    def grams(t: str) -> set[str]:
        p = f"^{t}$"
        return {p[k : k + 3] for k in range(max(1, len(p) - 2))}

    def fold(pdf: pd.DataFrame) -> list:
        leaders: list[tuple[str, int]] = []  # each with how many trigrams it has
        holders: dict[str, list[int]] = {}  # by trigram
        out = []
        for t in pdf[term]:
            g = grams(t)
            shared = Counter(k for x in g for k in holders.get(x, ()))
            beside = shared if least > 0 else range(len(leaders))
            k = min((k for k in beside if shared[k] / (len(g) + leaders[k][1] - shared[k]) >= least), default=None)
            if k is None:
                k = len(leaders)
                leaders.append((t, len(g)))
                for x in g:
                    holders.setdefault(x, []).append(k)
            out.append((t, leaders[k][0]))
        return out

    return folded(terms.select(*keys, term), keys, [term], fold, schema)


def subtitle_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Caption lines as subtitle events, in order."""
    text = F.concat(F.lit("Dialogue: 0,"), C.subtitle_clock(F.col("start_sec")), F.lit(","), C.subtitle_clock(F.col("end_sec")), F.lit(",Default,,0,0,0,,"), F.col("text"))
    return lines.select(*keys, "line_no", text.alias("event"))


def guests(rows: DataFrame, keys: list[str], guest: str, gap: float = 60.0, block: float | None = None) -> DataFrame:
    """Spans in which one guest speaks, without breaks of over `gap` seconds and without another guest between."""
    from vodlens.operators.islands import lagged, with_island

    order = ["start_sec", "segment_id"]
    marked = lagged(rows, keys, order, block, "i_first", p_g=guest, p_e="end_sec")
    spans = with_island(marked, keys, order, (F.col(guest) != F.col("p_g")) | (F.col("start_sec") - F.col("p_e") > gap), block, "i_first")
    return spans.groupBy(*keys, guest, "island").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("spoken_sec")).drop("island")


def storage_level(used_pct: Column, free_gb: Column) -> Column:
    return F.when((used_pct >= 100) | (free_gb < 10), "CRITICAL").when((used_pct >= 85) | (free_gb < 50), "WARNING").otherwise("OK")


def storage_usage(files: DataFrame, budget_bytes: int, free_bytes: int, least_free: int = 5 << 30, warning: float = 0.75, critical: float = 0.90) -> DataFrame:
    """The bytes of a folder's files (path, length) against a budget: one row, with the files of each class and the level.

    A file named proxy .. .mp4 is a recording's proxy; one named short, or in a folder named shorts, is a short.
    """
    name, folder = F.lower(F.element_at(F.split("path", "/"), -1)), F.lower(F.regexp_extract("path", "^(.*)/", 1))
    proxy = F.contains(name, F.lit("proxy")) & F.endswith(name, F.lit(".mp4"))
    short = ~proxy & (F.contains(name, F.lit("short")) | F.contains(folder, F.lit("shorts")))
    sums = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("used_bytes"), F.count_if(proxy).alias("n_proxies"), F.count_if(short).alias("n_shorts"))
    pct = 100 * F.col("used_bytes") / F.lit(budget_bytes) if budget_bytes > 0 else F.lit(0.0)
    level = F.when(F.lit(free_bytes <= least_free) | (pct >= 95), "HALT").when(pct >= 100 * critical, "CRITICAL").when(pct >= 100 * warning, "WARNING").otherwise("NORMAL")
    return sums.withColumns({"budget_usage_pct": F.round(pct, 2), "alert_level": level})


def stored_files(spark, path: str) -> DataFrame:
    """path and length of every file under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
