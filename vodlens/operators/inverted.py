"""A stored inverted index: postings by term, so that a query reads its terms' postings and no documents.

Postings (term, item, tf, doc_len) lie in partitions by a hash of the term, sorted by term within their
files: a search opens its terms' partitions only, and of those the row groups whose range of terms fits.
Lengths of the documents are kept apart, for the number and mean length that scores need. Removed
documents are kept as a list that searches and counts leave out; compacted() writes a new index without them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vodlens.functions import columns as C
from vodlens.plans.session import shared_folder

BUCKETS, FILE_ROWS, K1, B = 64, 2_000_000, 1.5, 0.75


@dataclass
class Inverted:
    """Where an index lies, and how many partitions it has."""

    spark: SparkSession
    path: str
    buckets: int

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            return None  # nothing written yet

    def removed(self) -> DataFrame | None:
        return self._read("removed")

    def _kept(self, rows: DataFrame) -> DataFrame:
        gone = self.removed()
        return rows if gone is None else rows.join(gone.select("item").distinct(), "item", "left_anti")

    def lengths(self) -> DataFrame | None:
        rows = self._read("lengths")
        return None if rows is None else self._kept(rows)

    def postings(self, terms: list[str]) -> DataFrame | None:
        """The postings of some terms."""
        rows = self._read("postings")
        if rows is None:
            return None
        wanted = {r.b for r in self.spark.createDataFrame([(t,) for t in set(terms)], "t string").select(bucket_of(F.col("t"), self.buckets).alias("b")).collect()}
        return self._kept(rows.where(F.col("bucket").isin(sorted(wanted)) & F.col("term").isin(sorted(set(terms)))).drop("bucket"))

    def add(self, docs: DataFrame, item: str, text: str) -> None:
        """Adds documents; their ids must be new (removed ones stay removed)."""
        tokens = C.index_tokens(F.col(text))
        terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
        self._write(docs.select(F.col(item).alias("item"), F.inline(counted(tokens))), terms)
        docs.select(F.col(item).alias("item"), F.size(tokens).alias("doc_len")).write.mode("append").parquet(f"{self.path}/lengths")

    def _write(self, postings: DataFrame, terms: DataFrame) -> None:
        """postings in one shuffle to the files that they go to; a partition of many (of which terms tell, a row for each posting) has several."""
        bucket, files = bucket_of(F.col("term"), self.buckets), [1] * self.buckets
        for r in terms.groupBy(bucket.alias("bucket")).count().collect():  # a row for each partition
            files[r["bucket"]] = -(-r["count"] // FILE_ROWS)
        deal = F.pmod(F.xxhash64("item"), F.get(F.array(*map(F.lit, files)), bucket))
        dealt = postings.repartition(bucket, deal).withColumn("bucket", bucket)
        dealt.sortWithinPartitions("bucket", "term", "item").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")

    def remove(self, items: DataFrame, item: str) -> None:
        items.select(F.col(item).alias("item")).write.mode("append").parquet(f"{self.path}/removed")

    def compacted(self, path: str | None = None) -> Inverted:
        """A new index with what is left."""
        out = Inverted(self.spark, path or fresh(self.spark), self.buckets)
        rows, lengths = self._read("postings"), self.lengths()
        if rows is not None:
            kept = self._kept(rows).drop("bucket")
            out._write(kept, kept)
        if lengths is not None:
            lengths.write.parquet(f"{out.path}/lengths")
        return out

    def bm25(self, query: list[str], k1: float = K1, b: float = B) -> DataFrame:
        """item and score of every document with a query term; repeated query terms count again."""
        found, lengths = self.postings(query), self.lengths()
        if found is None or lengths is None or not query:
            return self.spark.createDataFrame([], "item long, score double")
        stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avgdl"))  # one row
        df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each query term
        times = F.create_map(*[F.lit(x) for t in sorted(set(query)) for x in (t, query.count(t))])
        j = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
        idf = F.log1p(F.greatest(F.lit(0.0), (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        one = F.try_element_at(times, F.col("term")) * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
        return j.groupBy("item").agg(F.sum(one).alias("score"))


def counted(tokens: Column) -> Column:
    """An array of term, tf and doc_len: a document's words, counted where the document is.

    The sorted words are bound as a lambda variable, as in search.bm25, so that a text is cut once and not for each of its words.
    """

    def runs(t: Column) -> Column:
        starts = F.array_compact(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)))
        tf = lambda s, i, k: (F.coalesce(F.get(s, k + 1), F.size(t)) - i).cast("long")
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(t, i).alias("term"), tf(s, i, k).alias("tf"), F.size(t).alias("doc_len"))))

    return F.flatten(F.flatten(F.transform(F.array(F.sort_array(tokens)), runs)))


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inverted-{uuid.uuid4().hex}"


def build(docs: DataFrame, item: str, text: str, path: str | None = None, buckets: int = BUCKETS) -> Inverted:
    """An index of the words of some documents."""
    out = Inverted(docs.sparkSession, path or fresh(docs.sparkSession), buckets)
    out.add(docs, item, text)
    return out
