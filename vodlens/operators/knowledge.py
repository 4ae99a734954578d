"""Knowledge operators: claims, beliefs, consensus, grounding, entities and slang state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.functions import lexicons as L
from vodlens.plans.session import checkpointed


def claims(speech: DataFrame, keep: list[str], text: str = "transcript") -> DataFrame:
    """The first opinion of each segment: stance, polarity, attribute, subject; segments without one go."""
    low = F.lower(F.trim(text))
    stance = polarity = attribute = None
    for pattern, name, value in L.OPINIONS:
        hit = low.rlike(pattern)
        stance = F.when(hit, name) if stance is None else stance.when(hit, name)
        polarity = F.when(hit, value) if polarity is None else polarity.when(hit, value)
    for word, name in L.ATTRIBUTES:
        hit = F.contains(low, F.lit(word))
        attribute = F.when(hit, name) if attribute is None else attribute.when(hit, name)
    caps = F.filter(C.words(F.trim(text)), lambda w: (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & ~F.lower(w).isin(*L.NO_SUBJECT))
    caps = F.transform(caps, lambda w: F.btrim(w, F.lit(".,!?")))
    subject = F.when(F.size(caps) > 0, F.array_join(F.slice(caps, 1, 2), " ")).otherwise("Stream Topic")
    rows = speech.select(*keep, F.trim(text).alias("raw_quote"), stance.alias("stance"), polarity.alias("polarity"), attribute.otherwise("overall_verdict").alias("attribute"), subject.alias("subject_entity"))
    rows = rows.where("stance is not null")
    return rows.withColumn("predicate", F.concat(F.lit("has_"), "attribute")).withColumn("object_value", F.concat(F.lower("stance"), F.lit("_"), "attribute"))


def stance_of(mean: Column, edge: float = 0.35, names: tuple[str, str, str] = ("APPROVAL", "DISAPPROVAL", "NEUTRAL")) -> Column:
    return F.when(mean >= edge, names[0]).when(mean <= -edge, names[1]).otherwise(names[2])


def beliefs(found: DataFrame, keys: list[str]) -> DataFrame:
    """Mean polarity and stance per entity, and per attribute as sorted pairs."""
    by = found.groupBy(*keys, "subject_entity", "attribute").agg(F.avg("polarity").alias("p"), F.sum("polarity").alias("s"), F.count(F.lit(1)).alias("n"))
    per = by.groupBy(*keys, "subject_entity").agg((F.sum("s") / F.sum("n")).alias("aggregate_polarity"), F.sum("n").alias("claims_count"), F.sort_array(F.collect_list(F.struct("attribute", "p"))).alias("sub_attributes"))
    return per.withColumn("overall_stance", stance_of(F.col("aggregate_polarity")))


def grounded(citations: DataFrame, claim: str = "claim_id", snippet: str = "snippet") -> DataFrame:
    """The verdict of each claim by its citations: contradiction before outdated before confirmation."""
    low = F.lower(snippet)
    count = lambda words: F.sum(C.any_contained(low, words).cast("long"))
    per = citations.groupBy(claim).agg(count(L.CONTRADICTION).alias("n_against"), count(L.OUTDATED).alias("n_outdated"), count(L.CONFIRMATION).alias("n_for"))
    return per.withColumn("verdict", F.when(F.col("n_against") > 0, "CONTRADICTED").when(F.col("n_outdated") > 0, "OUTDATED").when(F.col("n_for") > 0, "VERIFIED_TRUE").otherwise("UNSUBSTANTIATED"))


def search_query(subject: Column, predicate: Column, value: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat_ws(" ", subject, predicate, value), r"[^A-Za-z0-9 _\-]", " "), " +", " "))


def entity_counts(rows: DataFrame, text: str, source: str, weights: dict[str, int], times: str | None = None) -> DataFrame:
    """Weighted counts of known entities, once per text, with counts per source; times: how often a row's text is there."""
    low = F.lower(text)
    hit = [F.when(low.rlike("|".join(patterns)), F.struct(F.lit(name).alias("entity"), F.lit(kind).alias("category"))) for kind, own in L.ENTITIES.items() for name, patterns in own.items()]
    n = F.lit(1) if times is None else F.col(times)
    found = rows.select(source, n.alias("times"), F.explode(F.array_compact(F.array(*hit))).alias("x")).select(source, "times", "x.entity", "x.category")
    weight = C.literal_map({k: float(v) for k, v in weights.items()})
    per = found.groupBy("entity", "category", source).agg(F.sum("times").alias("n"))
    return per.groupBy("entity", "category").agg(F.sum(F.col("n") * F.coalesce(F.try_element_at(weight, F.col(source)), F.lit(1.0))).alias("weighted"), F.sum("n").alias("n_texts"), F.sort_array(F.collect_list(F.struct(F.col(source).alias("source"), "n"))).alias("by_source"))


def leaks(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One alert for each kind of leak in a text: card, email, token or public address."""
    t = F.coalesce(F.col(text), F.lit(""))
    card, mail, ip = F.regexp_extract(t, L.LEAK_CARD, 0), F.regexp_extract(t, L.LEAK_EMAIL, 0), F.regexp_extract(t, L.LEAK_IP, 0)
    digits = F.regexp_replace(card, "[ -]", "")
    varied = (card != "") & (digits != F.repeat(F.substring(digits, 1, 1), F.length(digits)))
    alert = lambda kind, value, severity: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(severity).alias("severity"))
    found = F.array_compact(F.array(
        F.when(varied, alert("card", F.concat(F.substring(card, 1, 4), F.lit(" **** **** "), F.right(card, F.lit(4))), "critical")),
        F.when(mail != "", alert("email", mail, "warning")),
        F.when(t.rlike(L.LEAK_TOKEN), alert("token", F.lit(""), "critical")),
        F.when((ip != "") & ~F.startswith(ip, F.lit("127.")) & (ip != "0.0.0.0"), alert("ip", ip, "warning")),
    ))
    return rows.select(*keep, F.explode(found).alias("a")).select(*keep, "a.*")


def policy_audit(candidates: DataFrame, texts: DataFrame, keys: list[str], terms: list[str] = L.TOXIC_TERMS, speech: DataFrame | None = None, checked: DataFrame | None = None, bin_size: float = 60.0) -> DataFrame:
    """Toxic terms in what is said or written within each candidate, and the verdict.

    texts: keys, t, text. speech: keys, start_sec, end_sec, transcript; a segment counts where it meets
    the candidate. checked: keys, t, verification_status; a DEBUNKED or FALSE claim within a candidate flags it.
    """
    from vodlens.operators.temporal import overlap_join

    def hits(text: str) -> Column:
        low = F.lower(text)
        return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in terms])).alias("hit")

    # All that can count against a candidate goes through one join: what is written, what is said, what is false.
    marks = texts.select(*keys, F.col("t").alias("m_low"), F.col("t").alias("m_high"), hits("text"), F.lit(False).alias("debunked")).where(F.size("hit") > 0)
    if speech is not None:
        marks = marks.unionByName(speech.select(*keys, F.col("start_sec").alias("m_low"), F.col("end_sec").alias("m_high"), hits("transcript"), F.lit(False).alias("debunked")).where(F.size("hit") > 0))
    if checked is not None:
        false = checked.where(F.col("verification_status").isin("DEBUNKED", "FALSE"))
        marks = marks.unionByName(false.select(*keys, F.col("t").alias("m_low"), F.col("t").alias("m_high"), F.array().cast("array<string>").alias("hit"), F.lit(True).alias("debunked")))
    spans = candidates.select(*keys, "candidate_id", "start_sec", "end_sec")
    near = overlap_join(marks, spans, keys, ("m_low", "m_high"), ("start_sec", "end_sec"), bin_size).select("candidate_id", "debunked", F.explode_outer("hit").alias("w"))
    per = near.groupBy("candidate_id").agg(F.sort_array(F.collect_set("w")).alias("flagged_terms"), F.bool_or("debunked").alias("debunked"))
    out = candidates.join(per, "candidate_id", "left").withColumn("flagged_terms", F.coalesce("flagged_terms", F.array().cast("array<string>")))
    out = out.withColumn("toxicity_score", F.least(F.lit(1.0), F.size("flagged_terms") * 0.35))
    wrong = F.coalesce("debunked", F.lit(False))
    status = F.when(F.col("toxicity_score") >= 0.7, "REJECTED").when((F.col("toxicity_score") >= 0.35) | wrong, "FLAGGED").otherwise("PASSED")
    return out.withColumn("audit_status", status).drop("debunked")


def upsert_lexicon(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Folds a batch of terms into the adaptive lexicon: sums, maxima and blended confidence and valence."""
    s = state.select("term", *[F.col(c).alias(f"s_{c}") for c in state.columns if c != "term"])
    j = s.join(batch, "term", "full_outer")
    both = F.col("s_confidence").isNotNull() & F.col("confidence").isNotNull()
    pick = lambda new, c: F.when(both, new).otherwise(F.coalesce(c, f"s_{c}"))
    return j.select(
        "term",
        pick(F.least(F.lit(0.99), 0.4 * F.col("s_confidence") + 0.6 * F.col("confidence")), "confidence").alias("confidence"),
        pick(0.3 * F.col("s_valence") + 0.7 * F.col("valence"), "valence").alias("valence"),
        (F.coalesce("s_occurrences", F.lit(0)) + F.coalesce("occurrences", F.lit(0))).alias("occurrences"),
        F.greatest("s_peak_z", "peak_z").alias("peak_z"),
        F.greatest("s_last_seen", "last_seen").alias("last_seen"),
    )


def decayed(state: DataFrame, now: Column, half: float = 14.0, mark: float = 0.25, prune: float = 0.20) -> DataFrame:
    """Confidence halved every `half` days since last seen; the least confident go."""
    days = (F.unix_timestamp(now) - F.unix_timestamp("last_seen")) / 86400.0
    out = state.withColumn("decayed_confidence", C.half_life(F.col("confidence"), F.greatest(F.lit(0.0), days), half))
    return out.where(F.col("decayed_confidence") >= prune).withColumn("status", F.when(F.col("decayed_confidence") < mark, "DECAYED").otherwise("ACTIVE"))


def centroid_match(vectors: DataFrame, centroids: DataFrame, item: str, vec: str, threshold: float = 0.75, block_bytes: int = 8_000_000) -> DataFrame:
    """The most similar centroid of each vector (ties: smaller id), known if above its threshold.

    Centroids (enrolled profiles) come in blocks of about block_bytes, each in one broadcast row, and the best
    one is found within the vector's own row: no pair is ever a row, and no vector is moved. Beyond one
    block the best so far is stored between the blocks, so that no plan holds more than one of them.
    """
    size = centroids.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("centroid")).alias("numbers")).first()
    blocks = max(1, -(-8 * (size.numbers or 0) // block_bytes))
    out = vectors.select(item, F.col(vec).alias("v"), F.lit(None).cast("struct<sim:double,low:bigint>").alias("best"))
    for k in range(blocks):
        mine = centroids.where(F.pmod(F.xxhash64("centroid_id"), F.lit(blocks)) == k)
        held = mine.agg(F.collect_list(F.struct(F.col("centroid_id").cast("long").alias("id"), "centroid")).alias("held"))
        scored = F.transform("held", lambda c: F.struct(C.cosine(F.col("v"), c["centroid"]).alias("sim"), (-c["id"]).alias("low")))
        out = out.crossJoin(F.broadcast(held)).select(item, "v", F.greatest("best", F.array_max(scored)).alias("best"))  # one row
        if k < blocks - 1:
            out = checkpointed(out)
    found = out.where("best is not null")
    return found.select(item, (-F.col("best.low")).cast(centroids.schema["centroid_id"].dataType).alias("centroid_id"), F.col("best.sim").alias("sim"), (F.col("best.sim") >= threshold).alias("is_known"))


def centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """The normalised mean vector of each label, component by component."""
    parts = vectors.select(label, F.posexplode(vec).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    return mean.select(F.col(label).alias("centroid_id"), C.normalised(F.col("mean")).alias("centroid"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert by key: the last row of each."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("u_rank", F.row_number().over(w)).where("u_rank = 1").drop("u_rank")


def offline_citations(queries: DataFrame, item: str, text: str, rules: list[dict], fallback: dict) -> DataFrame:
    """A citation for each query without a search: the first rule of which a keyword is in the query, else the fallback.

    A rule: keywords, url, domain, title, confidence. In the fallback's url and title {query} is the
    query's beginning, percent-encoded in the url.
    """
    low, body = F.lower(text), F.coalesce(F.col(text), F.lit(""))
    cite = lambda r, url, title: F.struct(url.alias("url"), F.lit(r["domain"]).alias("domain"), title.alias("title"), F.lit(float(r["confidence"])).alias("confidence"))
    put = lambda template, value: F.concat(*[x for k, part in enumerate(template.split("{query}")) for x in ([value] if k else []) + [F.lit(part)]])
    quoted = F.replace(F.replace(F.url_encode(F.substring(body, 1, 30)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    out = cite(fallback, put(fallback["url"], quoted), put(fallback["title"], F.substring(body, 1, 40)))
    for r in reversed(rules):
        hit = F.lit(False)
        for w in r["keywords"]:
            hit = hit | F.contains(low, F.lit(w.lower()))
        out = F.when(hit, cite(r, F.lit(r["url"]), F.lit(r["title"]))).otherwise(out)
    return queries.select(item, out.alias("c")).select(item, "c.*")
