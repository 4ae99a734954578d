"""Stores: upserts, queues, admission, retention, event filters and run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vodlens.operators.knowledge import latest


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows replace the table's by key; within the batch the last of equal keys (by all columns) holds."""
    both = table.withColumn("u_gen", F.lit(0)).unionByName(batch.withColumn("u_gen", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("u_gen"), *[F.desc_nulls_last(c) for c in table.columns if c not in keys]]
    return latest(both, keys, order).drop("u_gen")


def delete(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys), keys, "left_anti")


def queue(vods: DataFrame, targets: DataFrame, key: str, status: Column, priority: list[Column], limit: int) -> DataFrame:
    return vods.where(status).join(targets, key).orderBy(*priority).limit(limit)


def admitted(queued: DataFrame, group: str, order: list[Column], per_group: int, total: int) -> DataFrame:
    """At most per_group of each group and total in all, in the order of the queue."""
    w = Window.partitionBy(group).orderBy(*order)
    return queued.withColumn("g_rank", F.row_number().over(w)).where(F.col("g_rank") <= per_group).orderBy(*order).limit(total)


def unknown(rows: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return rows.join(catalog.select(key), key, "left_anti")


def prune_plan(files: DataFrame, group: str, order: list[str], size: str, target: int) -> DataFrame:
    """Oldest first, the files to delete until `target` bytes are freed."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("freed_before") < target)


def json_filter(events: DataFrame, payload: str, conditions: dict[str, str], order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """AND of JSON-path equalities, ordered and paged."""
    out = events
    for path, value in conditions.items():
        out = out.where(F.get_json_object(payload, path) == value)
    return out.orderBy(*order).offset(offset).limit(limit)


def compare_runs(current: DataFrame, baseline: DataFrame, key: str, value: str, warn: float = 0.25, critical: float = 0.40) -> DataFrame:
    """Relative change of each stage of two runs, over the union of their stages."""
    a, b = current.select(key, F.col(value).alias("now")), baseline.select(key, F.col(value).alias("was"))
    j = a.join(b, key, "full_outer").fillna(0.0, ["now", "was"])
    change = F.when(F.col("was") > 0, (F.col("now") - F.col("was")) / F.col("was"))
    out = j.withColumn("change", change)
    return out.withColumn("level", F.when(F.col("was") == 0, "NEW").when(F.col("change") > critical, "CRITICAL").when(F.col("change") > warn, "WARNING").otherwise("OK"))


def validated(lines: DataFrame, column: str, schema: str, required: list[str]) -> DataFrame:
    """JSON texts parsed against a schema, with whether each is well formed and complete."""
    full = f"{schema}, _corrupt_record string"
    parsed = lines.withColumn("r", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    ok = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    for name in required:
        ok = ok & F.col(f"r.{name}").isNotNull()
    return parsed.withColumn("is_valid", F.coalesce(ok, F.lit(False)))


def page(rows: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def listing(vods: DataFrame, known: list[str], order: list[Column], streamer_id: str | None = None, status: str | None = None, search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a catalog. A search (in title and vod_id) looks at the streamer alone; a status that is not known filters nothing."""
    out = vods if streamer_id is None else vods.where(F.col("streamer_id") == streamer_id)
    if search:
        word = F.lit(search.lower())
        return out.where(F.contains(F.lower("title"), word) | F.contains(F.lower("vod_id"), word)).orderBy(*order).limit(limit)
    if status and status.upper() in known:
        out = out.where(F.col("status") == status.upper())
    return out.orderBy(*order).offset(offset).limit(limit)
