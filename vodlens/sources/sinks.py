"""Sinks: rosters, partitioned chunks with a manifest, text files, reports and decks.

Text files (subtitles, whole tables as HTML or Markdown) are written by Spark. The report functions
that return a text are of small results (one recording's highlights, one campaign): they raise where
there are more rows than their parameter allows, and leave none out.
"""

from __future__ import annotations

import html

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_roster(roster: DataFrame, path: str, kind: str = "json") -> None:
    """Streamer targets as JSON lines or CSV (lists joined by ;)."""
    if kind == "csv":
        lists = [f.name for f in roster.schema if f.dataType.typeName() == "array"]
        roster.withColumns({c: F.concat_ws(";", c) for c in lists}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        roster.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no roster format {kind}")


def write_chunk(rows: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Replaces just the chunks that rows hold: a chunk that is worked on again is written once."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def completed_chunks(spark: SparkSession, path: str, chunk: str = "chunk") -> DataFrame:
    return spark.read.parquet(path).select(chunk).distinct()


def finished(spark: SparkSession, root: str, phases: list[str], chunk: str = "chunk") -> DataFrame:
    """phase and chunk of every part that is complete, of the phases whose tables lie under root."""
    out = spark.createDataFrame([], f"phase string, {chunk} long")
    for phase in phases:
        try:
            done = completed_chunks(spark, f"{root}/{phase}", chunk)
        except AnalysisException:
            continue  # the phase has written nothing yet
        out = out.unionByName(done.select(F.lit(phase).alias("phase"), F.col(chunk).cast("long").alias(chunk)))
    return out


def bounded(rows: DataFrame, order: list[str], most: int) -> list:
    """All rows, sorted, on the driver; an error if there are more than `most`."""
    kept = rows.orderBy(*order).limit(most + 1).collect()
    if len(kept) > most:
        raise ValueError(f"over {most} rows; write the table with write_lines instead")
    return kept


def write_lines(rows: DataFrame, column: str, order: list[str], path: str, head: list[str] | None = None) -> None:
    """One text file of the column's lines in order, after the head's lines; of any size."""
    spark = rows.sparkSession
    key = [F.struct(*[F.col(c) for c in order]).alias("k"), F.col(column).alias("value")]
    first = spark.createDataFrame([(k, x) for k, x in enumerate(head or [])], "n long, value string")
    lines = first.select(F.lit(0).alias("part"), "n", "value").unionByName(rows.select(*key).orderBy("k").select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("n"), "value"))
    lines.coalesce(1).sortWithinPartitions("part", "n").select("value").write.mode("overwrite").text(path)


def report_html(title: str, rows: DataFrame, order: list[str], most: int = 500) -> str:
    """A table of at most `most` rows."""
    kept = bounded(rows, order, most)
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in rows.columns)
    body = "\n".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in kept)
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>\n<table><tr>{head}</tr>\n{body}\n</table></body></html>\n'


def deck_markdown(title: str, rows: DataFrame, order: list[str], most: int = 200) -> str:
    """A Markdown table of at most `most` rows."""
    kept = bounded(rows, order, most)
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|").replace("\n", " ") for x in xs) + " |"
    return "\n".join([f"# {title}", "", line(rows.columns), line("-" for _ in rows.columns), *map(line, kept)]) + "\n"


SUBTITLE_HEAD = ["[Script Info]", "ScriptType: v4.00+", "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"]


def subtitle_file(events: DataFrame, order: list[str], most: int = 20_000) -> str:
    """A subtitle file from subtitle events (one recording's lines); write_subtitles() has no bound."""
    return "\n".join([*SUBTITLE_HEAD, *(r.event for r in bounded(events, order, most))]) + "\n"


def write_subtitles(events: DataFrame, order: list[str], path: str) -> None:
    write_lines(events, "event", order, path, SUBTITLE_HEAD)
