"""The stored inverted index against the scan."""

import re

from pyspark.sql import functions as F

from vodlens.operators import inverted, search

ROWS = [(1, "the cat and the dog"), (2, "a dog, a dog!"), (3, "cat"), (4, ""), (5, None), (6, "The bird of the north and the south"), (7, "dog cat bird")]


def same(a, b):
    x, y = {r[0]: r[1] for r in a.collect()}, {r[0]: r[1] for r in b.collect()}
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-12 for k in x)


def test_scores_equal_the_scan(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "i long, t string")
    index = inverted.build(docs, "i", "t", str(tmp_path / "index"), 4)
    for q in (["the"], ["the", "dog", "the"], ["bird", "nothing"], ["nothing"]):
        same(index.bm25(q), search.bm25(docs, "i", "t", q))
    assert index.bm25([]).count() == 0


def test_a_text_is_cut_a_few_times_not_for_each_word(spark, tmp_path, monkeypatch):
    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        cut.add(1)
        return (text or "").split()

    monkeypatch.setattr(inverted.C, "index_tokens", words)
    docs = spark.createDataFrame([(1, " ".join(f"w{k % 300}" for k in range(900))), (2, "w0 " * 100), (3, None)], "i long, t string")
    index = inverted.build(docs, "i", "t", str(tmp_path / "index"), 4)
    assert cut.value <= 4 * 3
    got = index._read("postings").select("item", "term", "tf", "doc_len").collect()
    assert sorted(map(tuple, got)) == sorted([*((1, f"w{k}", 3, 900) for k in range(300)), (2, "w0", 100, 100)])


def test_partitions_of_many_postings_have_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "FILE_ROWS", 50)
    docs = spark.range(300).select(F.col("id").alias("i"), F.concat(F.lit("the the w"), F.col("id")).alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or small partitions are put together
    try:
        index = inverted.build(docs, "i", "t", str(tmp_path / "index"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = index._read("postings")
    assert rows.select(F.input_file_name()).distinct().count() > 2
    assert rows.where("term = 'the'").agg(F.count("*"), F.sum("tf"), F.countDistinct("item")).first()[:] == (300, 600, 300)
    small = index.compacted(str(tmp_path / "small"))
    assert sorted(map(tuple, small._read("postings").collect())) == sorted(map(tuple, rows.collect()))


def test_adding_removing_and_compacting(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "i long, t string")
    index = inverted.build(docs.where("i < 4"), "i", "t", str(tmp_path / "index"), 4)
    index.add(docs.where("i >= 4"), "i", "t")
    same(index.bm25(["dog", "the"]), search.bm25(docs, "i", "t", ["dog", "the"]))
    index.remove(docs.where("i IN (2, 4)"), "i")
    rest = docs.where("i NOT IN (2, 4)")
    same(index.bm25(["dog", "the"]), search.bm25(rest, "i", "t", ["dog", "the"]))
    small = index.compacted(str(tmp_path / "small"))
    same(small.bm25(["dog", "the"]), search.bm25(rest, "i", "t", ["dog", "the"]))
    assert small.removed() is None and small.lengths().count() == 5


def test_only_the_terms_partitions_are_read(spark, tmp_path):
    index = inverted.build(spark.createDataFrame(ROWS, "i long, t string"), "i", "t", str(tmp_path / "index"), 16)
    plan = index.postings(["dog"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = ", plan) and "EqualTo(term,dog)" in plan.replace("In(term, [dog])", "EqualTo(term,dog)")
    none = inverted.Inverted(spark, str(tmp_path / "nothing"), 4)
    assert none.bm25(["dog"]).count() == 0 and none.postings(["dog"]) is None
    assert index.postings(["dog"]).agg(F.sum("tf")).first()[0] == 4
