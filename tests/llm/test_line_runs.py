"""The registered line dedup goes through its runs: batches, merge anti-joins, compaction, no moved rows."""

from collections import Counter

from vodlens.llm import line_dedup, queries


def test_the_query_fills_levels(spark, data, monkeypatch):
    seen, joins = [], []
    drop, without = line_dedup.LineRuns.drop, line_dedup.LineRuns._without

    def watched(self):
        seen.append([len(x) for x in self.levels])
        drop(self)

    def joined(self, counts, least):
        out = without(self, counts, least)
        joins.append((len(self._runs()), least, out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(line_dedup.LineRuns, "drop", watched)
    monkeypatch.setattr(line_dedup.LineRuns, "_without", joined)
    assert queries.op8_line_dedup(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert seen == [[1, 2]] and line_dedup.BATCHES == 9 and line_dedup.FANOUT == 4
    assert [n for n, _, _ in joins] == [0, 1, 2, 3, 1, 2, 3, 4, 2] and {least for _, least, _ in joins} == {10}
    for n, _, plan in joins:
        # The batch is dealt once; no run is.
        assert plan.count("SortMergeJoin") == n and plan.count("Exchange") == 1


def test_runs_meet_without_moving(spark):
    runs = line_dedup.LineRuns(spark, fanout=9)
    docs = spark.createDataFrame([(k, f"a\nb {k}\nc {k % 3}") for k in range(12)], "doc_id long, text string")
    for k in range(3):
        runs.add(docs.where(f"doc_id % 3 = {k}"))
    batch = runs._runs()[0]
    plan = runs._without(batch, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and runs._without(batch, 0).count() == 0
    assert Counter(r.n for r in runs.merged().collect()) == {12: 1, 4: 3, 1: 12} and runs.merged().count() == 16
    runs.drop()


def test_closed_keys_are_left_out_and_still_frequent(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, closed=3)
    for k in range(6):
        docs = spark.createDataFrame([(j, "often\nrare " + str(k)) for j in range(3)] + [(9, "slow")], "doc_id long, text string")
        runs.append(line_dedup.key_counts(docs, "text", 1))
    found = {r.n for r in runs.merged().collect()}
    assert found == {3, 4} and runs.frequent(3).count() == 8
    runs.drop()


def test_batches_do_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(map(tuple, line_dedup.line_digests(docs, batches=1).collect()))
    assert sorted(map(tuple, line_dedup.line_digests(docs, batches=5).collect())) == want
