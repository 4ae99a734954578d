"""Production of shorts: chat evidence, hooks, cut plans, platform copy, score cards and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.operators.temporal import overlap_join, range_join

#: What is stripped from chat words, highlight colours by emotion (first match), and boxes (x, y, w, h).
PUNCTUATION = "!?,.:;\"'()"
COLOURS = [("LAUGHTER|HYSTERICAL", "&H0000FFFF"), ("HYPE|EXCITEMENT", "&H0000FF00"), ("CONTROVERSY|HOT_TAKE", "&H000080FF"), ("SHOCK|SCREAM", "&H000000FF")]
OTHER_COLOUR = "&H00FFFF00"
CAM, FULL_CAM, CONTENT, PAN = (0.65, 0.55, 0.35, 0.45), (0.20, 0.10, 0.60, 0.80), (0.0, 0.0, 0.75, 1.0), (0.15, 0.0, 0.70, 1.0)
BASE_TAGS = ["#fyp", "#viral", "#gaming", "#streamer", "#twitch"]


def chat_evidence(candidates: DataFrame, chat: DataFrame, keys: list[str], item: str, start: str, end: str, widest: float = 60.0, most: int = 5) -> DataFrame:
    """Per candidate: z (its rate against its stream's) and dominant (words of three letters or more, said twice or more).

    Messages are counted per candidate and word before anything is ranked.
    """
    span = chat.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_all"), F.greatest(F.lit(1.0), F.max("timestamp_offset") - F.min("timestamp_offset")).alias("span"))
    windows = candidates.select(*keys, item, F.col(start).alias("e_low"), F.col(end).alias("e_high"))
    near = range_join(chat.select(*keys, "message_id", "timestamp_offset", "content"), windows, keys, "timestamp_offset", "e_low", "e_high", widest)
    counts = near.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n_in"))
    words = near.select(*keys, item, "timestamp_offset", "message_id", F.posexplode(C.words(F.col("content"))).alias("place", "w"))
    words = words.withColumn("w", F.lower(F.btrim("w", F.lit(PUNCTUATION)))).where((F.length("w") >= 3) & ~F.startswith("w", F.lit("http")))
    per = words.groupBy(*keys, item, "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("timestamp_offset", "message_id", "place")).alias("first"))
    order = Window.partitionBy(*keys, item).orderBy(F.desc("n"), "first")
    top = per.where("n >= 2").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    dominant = top.groupBy(*keys, item).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("dominant"))
    j = windows.join(span, keys, "left").join(counts, [*keys, item], "left").join(dominant, [*keys, item], "left")
    mean = F.col("n_all") / F.col("span")
    rate = F.coalesce("n_in", F.lit(0)) / F.greatest(F.lit(1.0), F.col("e_high") - F.col("e_low"))
    z = C.clamp((rate - mean) / F.greatest(F.lit(0.5), 0.5 * mean), 0.0, 10.0)
    return j.select(*keys, item, F.when(F.col("n_all").isNull(), 1.5).otherwise(z).alias("z"), F.coalesce("dominant", F.array().cast("array<string>")).alias("dominant"))


def hooks(candidates: DataFrame, speech: DataFrame, keys: list[str], item: str, start: str, end: str, bin_size: float = 60.0, words: int = 12, summary: int = 160) -> DataFrame:
    """hook (first words of the first segment that meets the candidate) and summary (all their text, shortened)."""
    spans = candidates.select(*keys, item, F.col(start).alias("h_low"), F.col(end).alias("h_high"))
    said = speech.select(*keys, "segment_id", F.col("start_sec").alias("s_low"), F.col("end_sec").alias("s_high"), F.trim("transcript").alias("said"))
    met = overlap_join(said, spans, keys, ("s_low", "s_high"), ("h_low", "h_high"), bin_size)
    lines = met.groupBy(*keys, item).agg(F.sort_array(F.collect_list(F.struct("s_low", "segment_id", "said"))).alias("lines"))
    first = C.words(F.col("lines")[0]["said"])
    hook = F.concat(F.array_join(F.slice(first, 1, words), " "), F.when(F.size(first) > words, "...").otherwise(""))
    text = F.array_join(F.transform("lines", lambda x: x["said"]), " ")
    rest = lines.select(*keys, item, hook.alias("hook"), C.shorten(text, summary).alias("summary"))
    return candidates.join(rest, [*keys, item], "left").withColumns({"hook": F.coalesce("hook", F.lit("")), "summary": F.coalesce("summary", F.lit(""))})


def box(values: tuple[float, ...]) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip("xywh", values)])


def cut_plans(candidates: DataFrame, frames: DataFrame, keys: list[str], item: str, start: str, end: str, emotion: str, z: str, widest: float = 60.0) -> DataFrame:
    """Camera box, highlight colour and music level of each candidate, from the first telling frame in it.

    A frame tells where it shows the camera alone, or an object that is a face, a streamer or a person
    (its box as ymin, xmin, ymax, xmax).
    """
    found = F.get(F.filter("detected_objects", lambda o: F.lower(o["label"]).rlike("face|streamer|person")), F.lit(0))["box"]
    seen = F.struct(found[1].alias("x"), found[0].alias("y"), F.greatest(F.lit(0.2), found[3] - found[1]).alias("w"), F.greatest(F.lit(0.2), found[2] - found[0]).alias("h"))
    camera = F.when(F.col("scene_type") == "FULLSCREEN_CAM", box(FULL_CAM)).when(found.isNotNull(), seen)
    telling = frames.withColumn("camera", camera).where("camera is not null").select(*keys, "frame_index", "timestamp_sec", "camera")
    windows = candidates.select(*keys, item, F.col(start).alias("c_low"), F.col(end).alias("c_high"))
    near = range_join(telling, windows, keys, "timestamp_sec", "c_low", "c_high", widest)
    first = near.groupBy(*keys, item).agg(F.min_by("camera", F.struct("timestamp_sec", "frame_index")).alias("camera"))
    colour = F.lit(OTHER_COLOUR)
    for pattern, code in reversed(COLOURS):
        colour = F.when(F.upper(emotion).rlike(pattern), code).otherwise(colour)
    out = candidates.join(first, [*keys, item], "left")
    return out.withColumns({"facecam": F.coalesce("camera", box(CAM)), "content": box(CONTENT), "highlight_colour": colour, "duck_db": F.when(F.col(z) >= 3.0, -14.0).otherwise(-10.0)}).drop("camera")


def score_card(hook: Column, emotion: Column, z: Column, duration: Column, n_slang: Column, status: Column) -> dict[str, Column]:
    """The parts of a short's score, the composite, and the completion that it predicts."""
    strength = F.least(F.lit(100.0), 70.0 + F.when(F.length(hook) > 0, 15.0).otherwise(0.0) + F.when(emotion.isin("HYSTERICAL_LAUGHTER", "HYPE", "CONTROVERSY"), 10.0).otherwise(0.0))
    resonance = C.clamp(20.0 * z + 30.0, 20.0, 100.0)
    pacing = F.when(duration.between(20.0, 35.0), 95.0).when(duration.between(15.0, 50.0), 80.0).otherwise(65.0)
    meme = F.least(F.lit(100.0), 50.0 + n_slang * 12.0)
    overall = (0.35 * strength + 0.25 * resonance + 0.2 * pacing + 0.2 * meme) * F.when(status == "FLAGGED", 0.85).when(status == "REJECTED", 0.30).otherwise(1.0)
    completion = C.clamp(85.0 - duration * 0.3 + overall * 0.15, 50.0, 96.0)
    return {"hook_strength": strength, "chat_resonance": resonance, "pacing_score": pacing, "meme_potential": meme, "overall_virality_score": overall, "predicted_completion_rate": completion}


def hashtags(dominant: Column, disclosed: Column, terms: list[str] | None = None) -> Column:
    """The base tags, the words of the window and the lexicon's first three, and #ad where a sponsor is disclosed."""
    own = F.transform(F.filter(dominant, lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("#"), t))
    more = F.array(*[F.lit(f"#{t}") for t in (terms or [])[:3]]).cast("array<string>")
    tags = F.array_distinct(F.concat(F.array(*map(F.lit, BASE_TAGS)), own, more))
    return F.when(disclosed, F.array_append(tags, F.lit("#ad"))).otherwise(tags)


def macro_chapters(highlights: DataFrame, bounds: DataFrame, keys: list[str], item: str, ts: str, score: str, apart: float = 900.0, least: float = 0.60, peak: float = 0.85) -> DataFrame:
    """Chapters of a recording: its start, strong highlights at least `apart` seconds on, and its close.

    kind is start, climax, peak or close; wording is the caller's.
    """
    from vodlens.operators.folds import thinned

    strong = highlights.where(F.col(score) >= least).select(*keys, F.col(item).cast("string").alias("m_item"), F.col(ts).alias("m_t"), F.col(score).alias("m_score"))
    # The start of the recording counts as the first kept time.
    begin = bounds.select(*keys, F.lit("").alias("m_item"), F.lit(0.0).alias("m_t"), F.lit(None).cast("double").alias("m_score"))
    kept = thinned(begin.unionByName(strong), keys, "m_t", "m_item", apart)
    placed = kept.join(strong, [*keys, "m_item", "m_t"], "left")
    kind = F.when(F.col("m_item") == "", "start").when(F.col("m_score") >= peak, "peak").otherwise("climax")
    rows = placed.select(*keys, F.col("m_t").alias("t"), kind.alias("kind"))
    last = rows.groupBy(*keys).agg(F.max("t").alias("last")).join(bounds.select(*keys, "duration"), keys)
    close = last.where((F.col("duration") > 1800) & (F.col("duration") - F.col("last") >= 600)).select(*keys, (F.col("duration") - 300).alias("t"), F.lit("close").alias("kind"))
    return rows.unionByName(close).withColumn("label", C.clock(F.col("t")))


def thumbnails(highlights: DataFrame, keys: list[str], item: str, ts: str, score: str, least: float = 0.60, most: int = 4) -> DataFrame:
    """The times of the strongest highlights of each recording."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), ts, item)
    top = highlights.where(F.col(score) >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.select(*keys, "rank", F.round(ts, 1).alias("timestamp_sec"))


def words_around(words: DataFrame, clips: DataFrame, keys: list[str], item: str, start: str, end: str, widest: float = 60.0) -> DataFrame:
    """The words (word, start) spoken within each clip, in order."""
    windows = clips.select(*keys, item, F.col(start).alias("c_low"), F.col(end).alias("c_high"))
    near = range_join(words.select(*keys, "word", F.col("start").alias("at")), windows, keys, "at", "c_low", "c_high", widest)
    return near.groupBy(*keys, item).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"), F.count(F.lit(1)).alias("n_words"))


#: Wording of a package; {name}, {hours} and {n} are filled in. A caller may give its own.
TITLES = ["{name}: the moment that turned the stream", "{name} and the wildest live reaction of the day", "All of it live: {hours} hours with {name}"]
RECAP = ["Live for {length} with {n} highlight moments.", "Chapters: {chapters}."]
TAGS = ["stream highlights", "reaction", "full broadcast"]


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced by columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else values[p].cast("string") for k, p in enumerate(parts)])


def publication(chapters: DataFrame, highlights: DataFrame, bounds: DataFrame, keys: list[str], name: Column, ts: str, score: str, item: str, labels: dict[str, str], least: float = 0.60, titles: list[str] = TITLES, recap: list[str] = RECAP, tags: list[str] = TAGS) -> DataFrame:
    """Titles, chapter lines, recap lines, tags, description and thumbnail times of each recording.

    chapters: from macro_chapters(). labels: a wording for each kind of chapter, {k} being its number
    among the highlights. Without a highlight the thumbnails are at a quarter and half of the recording.
    """
    strong = highlights.where(F.col(score) >= least)
    counted = strong.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_strong"))
    top = thumbnails(highlights, keys, item, ts, score, least).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "timestamp_sec"))), lambda x: x["timestamp_sec"]).alias("top"))
    placed = chapters.withColumn("k", F.count_if(F.col("kind").isin("climax", "peak")).over(Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    wording = F.lit(None).cast("string")
    for kind, template in labels.items():
        wording = F.when(F.col("kind") == kind, filled(template, {"k": F.col("k")})).otherwise(wording)
    lines = placed.withColumn("line", F.concat_ws(" - ", C.clock(F.col("t")), wording)).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "line"))), lambda x: x["line"]).alias("chapter_lines"))
    j = bounds.select(*keys, "duration").join(lines, keys, "left").join(counted, keys, "left").join(top, keys, "left").withColumn("n_strong", F.coalesce("n_strong", F.lit(0)))
    values = {"name": name, "hours": F.floor(F.col("duration") / 3600), "length": C.clock(F.col("duration")), "n": F.col("n_strong"), "chapters": F.size("chapter_lines")}
    bullets = F.array(*[filled(t, values) for t in recap])
    out = j.withColumns({
        "titles": F.array(*[filled(t, values) for t in titles]), "recap": bullets, "tags": F.concat(F.array(F.lower(name)), F.array(*map(F.lit, tags))),
        "thumbnails": F.coalesce("top", F.array(F.round(F.col("duration") * 0.25, 1), F.round(F.col("duration") * 0.5, 1))),
        "description": F.concat(name, F.lit("\n\n"), F.array_join("chapter_lines", "\n"), F.lit("\n\n"), F.array_join(bullets, "\n")),
    })
    return out.select(*keys, "titles", "chapter_lines", "recap", "tags", "thumbnails", "description")


PACKAGE = "candidate_id string, start_sec double, end_sec double, audit_status string, overall_virality_score double, title string"


def write_packages(packages: DataFrame, path: str, per_file: int = 1) -> None:
    """Packages as JSON files, `per_file` in each at most."""
    packages.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def read_packages(spark, path: str, pattern: str = "*.json") -> DataFrame:
    """The packages of a folder; what is no package (no JSON, or none with an id) is left out."""
    rows = spark.read.schema(PACKAGE).option("mode", "DROPMALFORMED").option("pathGlobFilter", pattern).json(path)
    return rows.where(F.col("candidate_id").isNotNull()).withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))
