"""Sponsor operators: mentions, segments, impact and contract audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.functions import lexicons as L
from vodlens.operators.chat import polarity_sums
from vodlens.operators.islands import lagged, with_island
from vodlens.operators.temporal import range_join


def mentions(speech: DataFrame, keyframes: DataFrame, keys: list[str], brands: list[dict]) -> DataFrame:
    """Spoken and shown mentions of each brand: keys, brand_id, kind, start_sec, end_sec, text.

    brands: dicts of brand_id, brand_name, aliases, promo_codes, product_keywords; a short list, which
    becomes a part of the expression.
    """
    shown = keyframes.select(*keys, F.lit("ocr").alias("kind"), F.col("timestamp_sec").alias("start_sec"), F.col("timestamp_sec").alias("end_sec"), F.explode("ocr_text_blocks").alias("text"))
    said = speech.select(*keys, F.lit("audio").alias("kind"), "start_sec", "end_sec", F.col("transcript").alias("text"))

    def match(b: dict):
        hit = F.lit(False)
        for term in [b["brand_name"], *b.get("aliases", []), *b.get("promo_codes", [])]:
            hit = hit | C.fuzzy_match(term, F.col("text"))
        return F.when(hit, F.lit(b["brand_id"]))

    found = said.unionByName(shown).withColumn("brand_id", F.explode(F.array_compact(F.array(*map(match, brands)))))
    return found.select(*keys, "brand_id", "kind", "start_sec", "end_sec", "text")


def segments(found: DataFrame, keys: list[str], gap: float = 30.0, block: float | None = None) -> DataFrame:
    """Mentions clustered where each starts at most `gap` after the one before it ends."""
    by = [*keys, "brand_id"]
    order = ["start_sec", "kind", "end_sec", "text"]
    marked = with_island(lagged(found, by, order, block, "i_first", p_end="end_sec"), by, order, F.col("start_sec") - F.col("p_end") > gap, block, "i_first")
    return marked.groupBy(*by, F.col("island").alias("segment_id")).agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"),
        F.sum((F.col("kind") == "audio").cast("long")).alias("n_audio"), F.sum((F.col("kind") == "ocr").cast("long")).alias("n_ocr"),
    )


def impact(chat: DataFrame, segs: DataFrame, keys: list[str], terms: dict[str, list[str]], buffer: float = 60.0) -> DataFrame:
    """Chat around each segment against the stream's baseline. terms: brand_id to lower-case terms."""
    total, hits = polarity_sums(F.col("content"))
    low = F.lower("content")
    tokens = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))
    about = F.array_compact(F.array(*[F.when(C.any_contained(low, t), F.lit(b)) for b, t in terms.items()]))
    back = F.arrays_overlap(tokens, F.array(*map(F.lit, L.BACKLASH_TOKENS)))
    rows = chat.select(*keys, "timestamp_offset", total.alias("p"), hits.alias("h"), about.alias("about"), back.alias("back"))
    base = rows.groupBy(*keys).agg((F.sum("p") / F.when(F.sum("h") > 0, F.sum("h"))).alias("baseline"))
    windows = segs.withColumn("w_low", F.greatest(F.lit(0.0), F.col("start_sec") - buffer)).withColumn("w_high", F.col("end_sec") + buffer)
    near = range_join(rows, windows, keys, "timestamp_offset", "w_low", "w_high", 2 * buffer)
    per = near.groupBy(*keys, "brand_id", "segment_id").agg(
        F.count(F.lit(1)).alias("n_messages"), (F.sum("p") / F.when(F.sum("h") > 0, F.sum("h"))).alias("mood"),
        F.sum(F.array_contains("about", F.col("brand_id")).cast("long")).alias("mentions"), F.sum(F.col("back").cast("long")).alias("backlash"),
    )
    out = windows.join(per, [*keys, "brand_id", "segment_id"], "left").join(base, keys, "left").fillna(0, ["n_messages", "mentions", "backlash"]).fillna(0.0, ["mood", "baseline"])
    index = F.when(F.col("n_messages") > 0, F.col("backlash") / F.col("n_messages")).otherwise(0.0)
    out = out.withColumn("sentiment_delta", F.col("mood") - F.col("baseline")).withColumn("backlash_index", index)
    out = out.withColumn("mention_velocity", F.col("mentions") / F.greatest(F.lit(1.0), F.col("w_high") - F.col("w_low")))
    score = 100 * (0.4 * F.least(F.lit(1.0), F.col("mentions") / 50.0) + 0.3 * ((F.col("mood") + 1) / 2) + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("backlash_index")))
    return out.withColumn("attention_score", C.clamp(score, 0.0, 100.0))


def contract_audit(chat: DataFrame, speech: DataFrame, segs: DataFrame, keys: list[str], brand_id: str, keywords: list[str], promo: str | None, contracted_sec: float) -> DataFrame:
    """Air time, talking points, chat response and earned value of one brand's segments per stream."""
    own = segs.where(F.col("brand_id") == brand_id)
    air = own.groupBy(*keys).agg(F.min("start_sec").alias("air_start"), F.max("end_sec").alias("air_end"), F.sum(F.col("end_sec") - F.col("start_sec")).alias("airtime_sec"), F.sum(F.when(F.col("n_ocr") > 0, F.col("end_sec") - F.col("start_sec")).otherwise(0.0)).alias("logo_sec"))
    said = speech.join(air, keys).where((F.col("end_sec") >= F.col("air_start")) & (F.col("start_sec") <= F.col("air_end"))).select(*keys, F.lower("transcript").alias("t"))
    words = [*keywords, *([promo] if promo else [])]
    spoken = said.groupBy(*keys).agg(*[F.max(F.contains("t", F.lit(w.lower()))).alias(f"k{k}") for k, w in enumerate(words)])
    low = F.lower("content")
    total, hits = polarity_sums(F.col("content"))
    good = (F.when(hits > 0, total / hits).otherwise(0.0) > 0.15) | C.any_contained(low, L.POSITIVE_CHAT)
    heard = chat.join(air, keys).where(F.col("timestamp_offset").between(F.col("air_start"), F.col("air_end")))
    mood = heard.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("long")).alias("n_positive"), F.sum(C.any_contained(low, L.PURCHASE_TRIGGERS).cast("long")).alias("n_intent"))
    out = air.join(spoken, keys, "left").join(mood, keys, "left").fillna(0, ["n", "n_positive", "n_intent"]).fillna(False, [f"k{k}" for k in range(len(words))])
    met = sum((F.col(f"k{k}").cast("int") for k in range(len(keywords))), F.lit(0))
    out = out.withColumn("keyword_pct", met * 100.0 / max(1, len(keywords)) if keywords else F.lit(100.0))
    out = out.withColumn("promo_mentioned", F.col(f"k{len(words) - 1}") if promo else F.lit(True))
    out = out.withColumn("positive_pct", F.when(F.col("n") > 0, F.col("n_positive") * 100.0 / F.col("n")).otherwise(75.0)).withColumn("is_estimated", F.col("n") == 0)
    out = out.withColumn("earned_value", F.col("airtime_sec") * 15.0 * (1 + F.col("positive_pct") / 100) + F.col("n_intent") * 25.0)
    passed = (F.col("keyword_pct") >= 80) & F.col("promo_mentioned") & (F.col("airtime_sec") >= contracted_sec * 0.8)
    return out.select(*keys, "airtime_sec", "logo_sec", "keyword_pct", "promo_mentioned", "positive_pct", "n_intent", "earned_value", "is_estimated", passed.alias("compliance_passed"))
