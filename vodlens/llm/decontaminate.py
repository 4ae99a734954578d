"""Benchmark decontamination: spaced-seed hashing; DataFrame functions only.

Words are runs of other than ASCII white space, A-Z lower-cased. A mask is a pattern over SPAN
neighbouring words: it hashes the words at its kept positions and ignores the others, so a hit
survives a changed word wherever one mask ignores it. Every window of every benchmark item gives a
hash for each mask; every window of every document is looked up among them.

A hit fixes a diagonal (document position minus item position); hits are made distinct by document,
item and diagonal before anything is compared, so that a repetitive item costs no more than its
diagonals. Verification lays the item along the diagonal and compares word by word. A document is
contaminated where a run of RUN neighbouring item words (the whole item, if it is shorter) stands in
it with at least SIMILARITY of its words equal; the rest may be substituted. Items of under SEEDED words
have masks of their own length instead, one for each word to be ignored, and those of under LEAST words, in
which no word may differ, a hash of the whole item (the lengths that the benchmark has are looked up, and no other).

The first pass keeps only row keys and diagonals. Texts are read again for rows with hits alone. Seeds,
items and hits are broadcast only while their counted rows are at most MAX_BROADCAST; beyond that they
are joined by shuffle, on the hashes and then on the rows' keys.

Defined results: a null text counts as empty; items without id, text or words match nothing; repeated
rows of either table give the same single row for a (doc_id, item_id); empty tables give no rows; other
columns are ignored (pairs) or kept (clean).
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vodlens.llm.common import ASCII_SPACE, ascii_lower, drop_stored, stored
from vodlens.llm.line_dedup import row_key

SPAN = 7
#: Kept positions of each mask. Wherever the changes lie that verification allows, in a run of RUN words
#: or in an item of any size from SEEDED words, at least one mask fits between them (found and tested by
#: enumeration).
MASKS = [(0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 2, 4, 6), (0, 3, 4, 5, 6)]
#: Words of the shortest item that the masks seed, and of the shortest one of which a word may differ.
SEEDED, LEAST = 8, 5
RUN, SIMILARITY = 13, 0.8
MAX_BROADCAST = 400_000


def word_hashes(text: Column) -> Column:
    """The hash of each word of a text."""
    bare = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds_of(words: Column) -> Column:
    """The hashes of all windows and masks; those of window k stand at len(MASKS) * k and after."""
    none = F.array().cast("array<bigint>")
    last = F.size(words) - SPAN
    window = lambda i: F.array(*[F.xxhash64(F.lit(k), *[F.get(words, i + o) for o in mask]) for k, mask in enumerate(MASKS)])
    return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window))).otherwise(none)


def with_seeds(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each seed: keep, place (of the window) and seed."""
    seeds = rows.select(*keep, seeds_of(F.col("words")).alias("seeds"))
    # The outer form: for the inner one the optimizer adds a filter on the size, which would compute
    # the hashes anew for every window.
    placed = seeds.select(*keep, F.posexplode_outer("seeds").alias("k", "seed"))
    return placed.select(*keep, (F.col("k") / len(MASKS)).cast("int").alias("place"), "seed")


def verified(hits: DataFrame, run: int, similarity: float) -> DataFrame:
    """Hits (key, words, item_id, item, diagonal) that hold, with the words equal along the diagonal."""
    size = F.size("item")
    equal = F.transform("item", lambda x, i: F.coalesce((F.get(F.col("words"), F.col("diagonal") + i) == x).cast("int"), F.lit(0)))
    laid = hits.select("key", "doc_id", "item_id", size.alias("item_words"), equal.alias("equal"))
    total = F.aggregate("equal", F.lit(0), lambda a, x: a + x)
    laid = laid.withColumn("equal_words", total).withColumn("span", F.least(F.lit(run), F.col("item_words")))
    need = F.ceil(F.col("span") * F.lit(similarity))
    starts = F.sequence(F.lit(1), F.col("item_words") - F.col("span") + 1)
    held = F.exists(starts, lambda s: F.aggregate(F.slice("equal", s, F.col("span")), F.lit(0), lambda a, x: a + x) >= need)
    good = F.when(F.col("equal_words") >= F.col("item_words") * F.lit(similarity), True).when(F.col("equal_words") < need, False).otherwise(held)
    return laid.where(good).select("key", "doc_id", "item_id", "item_words", "equal_words")


def ignored(n: int) -> list[int | None]:
    """The words that a short item's masks ignore, one each; none where no word may differ."""
    return list(range(n)) if n >= LEAST else [None]


def run_hash(n: int, skip: int | None, start: Column) -> Column:
    """The hash of n neighbouring words without the ignored one."""
    return F.xxhash64(F.lit(-n), F.lit(-1 if skip is None else skip), *[F.get(F.col("words"), start + o) for o in range(n) if o != skip])


def with_runs(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """Like with_seeds, with the hashes of each run of as many words as a short item has.

    A run whose first or last word is ignored may begin before the text or end behind it.
    """
    parts = []
    for n in lengths:
        for skip in ignored(n):
            first, last = -int(skip == 0), F.size("words") - n + int(skip == n - 1)
            starts = F.when(last >= first, F.sequence(F.lit(first), F.greatest(last, F.lit(first)))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, partial(placed_run, n, skip)))
    return rows.select(*keep, F.explode_outer(F.flatten(F.array(*parts))).alias("s")).select(*keep, "s.place", "s.seed")


def placed_run(n: int, skip: int | None, start: Column) -> Column:
    return F.struct(start.cast("int").alias("place"), run_hash(n, skip, start).alias("seed"))


def seeds_and_runs(rows: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    placed = with_seeds(rows, *keep)
    return placed.unionByName(with_runs(rows, lengths, *keep)) if lengths else placed


def hits_of(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, similarity: float = SIMILARITY, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """key (of the row), doc_id, item_id, item_words, equal_words: a row for each hit that holds."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("words"))
    items = stored(items.where(F.size("words") > 0).dropDuplicates(["item_id", "words"]).withColumn("item", F.xxhash64("item_id", "words")), "decon-items")
    short = items.where(F.size("words") < SEEDED)
    lengths = sorted(r.n for r in short.select(F.size("words").alias("n")).distinct().collect())  # seven at most
    seeds = with_seeds(items.where(F.size("words") >= SEEDED), "item")
    for n in lengths:
        hashes = F.array(*[run_hash(n, skip, F.lit(0)) for skip in ignored(n)])
        seeds = seeds.unionByName(short.where(F.size("words") == n).select("item", F.lit(0).alias("place"), F.explode(hashes).alias("seed")))
    seeds = stored(seeds.where("seed is not null").distinct().select(F.col("item").alias("s_item"), F.col("place").alias("s_place"), F.col("seed").alias("s_seed")), "decon-seeds")
    rows = docs.select(row_key(id_col, text_col).alias("key"), word_hashes(F.col(text_col)).alias("words"))
    placed = seeds_and_runs(rows, lengths, "key")
    few = F.broadcast if seeds.count() <= max_broadcast else lambda df: df
    found = placed.join(few(seeds), F.col("seed") == F.col("s_seed")).select("key.*", "s_item", (F.col("place") - F.col("s_place")).alias("diagonal"))
    found = stored(found.distinct(), "decon-hits")
    drop_stored(seeds)
    texts = items.select("item", "item_id", F.col("words").alias("item_hashes"))
    if found.count() <= max_broadcast:
        found = F.broadcast(found)
    again = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = again.join(found, (F.col("key.d1") == F.col("d1")) & (F.col("key.d2") == F.col("d2"))).join(few(texts), F.col("s_item") == F.col("item"))
    # The generator keeps the optimizer from hashing the words anew for each word that is compared.
    hits = hits.select("key", "doc_id", "item_id", F.col("item_hashes").alias("item"), "diagonal", F.explode_outer(F.array(word_hashes(F.col("text")))).alias("words"))
    return verified(hits, run, similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, item_words and equal_words (along the best diagonal) of each contaminated pair."""
    hits = hits_of(docs, benchmark, **options)
    return hits.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("item_words"), F.max("equal_words").alias("equal_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark passage, with all their columns."""
    found = stored(hits_of(docs.select("doc_id", "text"), benchmark, **options).select("key.*").distinct(), "decon-rows")
    marked = docs.withColumn("k_key", row_key("doc_id", "text"))
    rest = marked.join(found, (F.col("k_key.d1") == F.col("d1")) & (F.col("k_key.d2") == F.col("d2")), "left_anti")
    return rest.select(*docs.columns)
