"""URL filters: a trie over reversed host labels and path segments, longest match first.

A rule's host fits the host itself and every subdomain; its path fits each url path that starts
with it. Of several fitting rules the longest (host and path, in characters) wins; of those of equal
length the one listed last, and so where an allow and a block rule are equal in text. Without a fitting
rule the verdict is the filter's default.

The trie is a part of each task, so its size is checked: beyond MAX_RULES the rules are joined
instead, on the host suffixes and path prefixes of each url.

Defined results: a null url, or one without "://", has an empty host and path and gets the default;
repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.llm.common import ascii_lower

MAX_RULES = 200_000
#: The rules of the registered query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


class RuleTrie:
    """Nodes are dicts. Host labels lead down from the top-level domain, then path segments follow.

    A rule's last path segment is kept apart at its node (key TAILS), since it need only be the
    beginning of a url's segment: /en fits /english, /en/ ends in an empty segment that fits all. The
    beginnings of a segment are looked up by the lengths that the node's tails have (key SIZES), so
    that many rules at one node cost no more than their distinct lengths.
    """

    PATHS, TAILS, SIZES = 0, 1, 2  # labels and segments are strings, so these cannot clash

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for order, (host, path, verdict) in enumerate(rules):
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self.PATHS, {})
            *segments, tail = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            node.setdefault(self.TAILS, {})[tail] = (host + path, verdict, order)
            node.setdefault(self.SIZES, set()).add(len(tail))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, rank, node = None, (-1, -1), self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            place = node.get(self.PATHS)
            for segment in segments if place is not None else ():
                tails = place.get(self.TAILS)
                for size in place[self.SIZES] if tails else ():
                    rule = tails.get(segment[:size]) if size <= len(segment) else None
                    if rule and (len(rule[0]), rule[2]) > rank:
                        best, rank = rule[:2], (len(rule[0]), rule[2])
                place = place.get(segment)
                if place is None:
                    break
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as plain text, both empty without "://"."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _by_join(parts: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The other way, for rule lists that are too long to send to every task."""
    spark = parts.sparkSession
    listed = spark.createDataFrame([(h.lower(), p, h + p, v, k) for k, (h, p, v) in enumerate(rules)], "r_host string, r_path string, rule string, rule_verdict string, r_order long")
    listed = listed.withColumn("r_rank", F.row_number().over(Window.partitionBy("r_host", "r_path").orderBy(F.desc("r_order")))).where("r_rank = 1")
    urls = parts.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).drop("n")
    labels = F.split("host", r"\.")
    hosts = urls.withColumn("r_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    fitting = hosts.join(listed, "r_host").where(F.startswith("path", "r_path"))
    best = fitting.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "r_order")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = DEFAULT, max_rules: int = MAX_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (its host and path, else null) and verdict of every row."""
    url = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    parts = url.select("page_id", host.alias("host"), path.alias("path"))
    if len(rules) > max_rules:
        return _by_join(parts, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            found = [match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) END AS rest
        FROM pages)),
rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
         arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
  FROM parts JOIN rules ON (host = r_host OR suffix(host, '.' || r_host)) AND prefix(path, r_path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""
