"""Search operators: chunks, postings, BM25, vectors, hybrid ranking and grouped evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.plans.session import checkpointed


def postings(docs: DataFrame, item: str, text: str) -> DataFrame:
    """item, term, tf, doc_len of every document."""
    tokens = docs.select(item, C.index_tokens(F.col(text)).alias("t"))
    rows = tokens.select(item, F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    return rows.groupBy(item, "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, item: str, text: str, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """item and score of every document with a query term; repeated query terms count again.

    Documents are read and cut into words once: lengths and counts of the query's terms, all integers,
    are checkpointed; the global sums and the scores come from those.
    """
    terms = sorted(set(query))
    names = ["dl", *(f"tf{k}" for k in range(len(terms)))]
    # The words are bound as a lambda variable, or they would be cut anew for each term.
    counts = F.transform(F.array(C.index_tokens(F.col(text))), lambda t: F.struct(F.size(t).alias("dl"), *[F.size(F.filter(t, equals(q))).alias(f"tf{k}") for k, q in enumerate(terms)]))
    counted = checkpointed(docs.select(item, F.inline(counts)).toDF(item, *names))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k, q in enumerate(terms):
        idf = F.log1p(F.greatest(F.lit(0.0), (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)))
        tf = F.col(f"tf{k}")
        score = score + query.count(q) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = sum((F.col(f"tf{k}") for k in range(len(terms))), F.lit(0)) > 0
    return joined.where(hit).select(item, score.alias("score"))


def top(rows: DataFrame, k: int, score: str, item: str) -> DataFrame:
    return rows.orderBy(F.desc(score), item).limit(k)


def cosine_scores(vectors: DataFrame, item: str, vec: str, query: list[float]) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(item, C.cosine(F.col(vec), q).alias("score"))


def hybrid(sparse: DataFrame, dense: DataFrame, item: str, weight: float = 0.5, least: float = 0.0, digits: int = 4) -> DataFrame:
    """(1 - weight) * bm25 / max bm25 + weight * max(0, cosine), filtered before it is rounded."""
    best = sparse.agg(F.max("score").alias("best"))
    s = sparse.crossJoin(F.broadcast(best)).select(item, (F.col("score") / F.when(F.col("best") > 0, F.col("best"))).alias("sparse_score"))
    d = dense.select(item, F.greatest(F.lit(0.0), "score").alias("dense_score"))
    both = d.join(s, item, "full_outer").fillna(0.0, ["sparse_score", "dense_score"])
    out = both.withColumn("combined", (1 - weight) * F.col("sparse_score") + weight * F.col("dense_score")).where(F.col("combined") >= least)
    return out.withColumn("combined_score", F.round("combined", digits)).drop("combined")


def evidence(results: DataFrame, by: str, kind: str, text: str, score: str, item: str, most: dict[str, int], total: int = 5, quote: int = 200) -> DataFrame:
    """The best results of each kind per group, at most `total` citations, with shortened quotes."""
    w = Window.partitionBy(by, kind).orderBy(F.desc(score), item)
    cap = C.literal_map({k: float(v) for k, v in most.items()})
    kept = results.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.coalesce(F.try_element_at(cap, F.col(kind)), F.lit(0.0)))
    return kept.orderBy(F.desc(score), item).limit(total).select(by, kind, item, score, C.shorten(F.col(text), quote).alias("quote"))


def embedded(docs: DataFrame, item: str, text: str, dim: int = 128) -> DataFrame:
    """Hash embeddings of texts: signed buckets, weights falling with position, unit length.

    A text without tokens has the zero vector.
    """
    tokens = docs.select(item, F.posexplode_outer(C.index_tokens(F.col(text))).alias("place", "token"))
    sign = F.when(F.pmod(F.xxhash64("token", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    parts = tokens.select(item, F.pmod(F.xxhash64("token"), F.lit(dim)).cast("int").alias("at"), (sign / (1 + 0.05 * F.col("place"))).alias("w"), F.col("token").isNull().alias("none"))
    sums = parts.where("not none").groupBy(item, "at").agg(F.sum("w").alias("w"))
    vectors = sums.groupBy(item).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))
    zero = F.array_repeat(F.lit(0.0), dim)
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("size"))
    rows = docs.select(item).join(vectors, item, "left")
    return rows.select(item, F.when(F.col("size") > 0, value).otherwise(zero).alias("embedding"))


def chat_context(chunks: DataFrame, chat: DataFrame, keys: list[str], item: str, ts: str, around: float = 10.0, most: int = 10, take: list[str] | None = None) -> DataFrame:
    """Up to `most` chat rows within `around` seconds of each chunk's start, in time order; take: more of their columns.

    A key's messages are numbered in order, so that a chunk meets the `most` that follow its window's
    start, however many there are in it.
    """
    from vodlens.operators import scans

    take = take or []
    said = F.struct(*dict.fromkeys(["timestamp_offset", "message_id", *take]))
    messages = chat.where("timestamp_offset IS NOT NULL").select(*keys, F.col("timestamp_offset").cast("double").alias("c_at"), F.lit(1).alias("c_side"), F.col("message_id").alias("c_tie"), said.alias("m"))
    low, high = F.col(ts) - around, F.col(ts) + around
    starts = chunks.where(high >= low).select(*keys, low.cast("double").alias("c_at"), F.lit(0).alias("c_side"), F.lit(None).cast(messages.schema["c_tie"].dataType).alias("c_tie"), F.struct(F.col(item), high.alias("w_high")).alias("c"))
    both = scans.scan(messages.unionByName(starts, allowMissingColumns=True), keys, "c_at", ["c_at", "c_side", "c_tie"], 96 * around, c_n=scans.Scan("sum", F.col("c_side").cast("long")))
    wanted = both.where("c_side = 0").select(*keys, "c.*", F.explode(F.sequence(F.col("c_n") + 1, F.col("c_n") + most)).alias("c_n"))
    near = wanted.join(both.where("c_side = 1").select(*keys, "c_n", "m"), [*keys, "c_n"]).where(F.col("m.timestamp_offset") <= F.col("w_high"))
    w = Window.partitionBy(*keys, item).orderBy("m.timestamp_offset", "m.message_id")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select(*keys, item, "r", "m.message_id", *[f"m.{c}" for c in take])


def filtered(chunks: DataFrame, streamer_ids: list[str] | None = None, vod_ids: list[str] | None = None, content_types: list[str] | None = None, start: float | None = None, end: float | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Chunks that fit every given condition; each reaches the scan."""
    for column, values in (("streamer_id", streamer_ids), ("vod_id", vod_ids), ("content_type", content_types)):
        if values:
            chunks = chunks.where(F.col(column).isin(*values))
    if start is not None:
        chunks = chunks.where(F.col("timestamp_sec") >= start)
    if end is not None:
        chunks = chunks.where(F.col("timestamp_sec") <= end)
    for key, value in (metadata or {}).items():
        chunks = chunks.where(F.get_json_object("metadata", f"$.{key}") == value)
    return chunks


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, recordings and streamers, in all and by content type."""
    return chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("vod_id").alias("n_vods"), F.countDistinct("streamer_id").alias("n_streamers"))
