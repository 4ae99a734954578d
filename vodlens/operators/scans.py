"""Ordered windows on hot keys: a two-level prefix scan.

A window that is partitioned by key alone puts a key's rows into one task. Here a key's time axis is cut
into blocks: within a block the window runs as usual, each block gives a summary (its sum, its last
value ..), the summaries of a key are scanned in block order, and what came before a block is joined back
to its rows. The large side is shuffled once, by key and block; the summaries are as many as the blocks.

All of it is built-in expressions. Rows of equal time are of one block; a null time is a block of its
own, before all others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Scan:
    """What is carried along: kind is sum, max, min, last (value before or here) or next (here or after).

    Null values are passed over, wrap them in a struct to see them. own: whether the row itself counts.
    """

    kind: str
    column: Column
    own: bool = True


LOCAL = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True), "next": lambda c: F.last(c, ignorenulls=True)}


def _joined(kind: str, local: Column, carried: Column) -> Column:
    """A block's own value with what lies beyond the block."""
    if kind == "sum":
        return F.when(local.isNull(), carried).when(carried.isNull(), local).otherwise(local + carried)
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(local, carried)
    return F.coalesce(local, carried)


def scan(rows: DataFrame, keys: list[str], ts: str, order: list[str], block: float, **scans: Scan) -> DataFrame:
    """rows with a column for each scan along `order`, which begins with the time column `ts`.

    block: the width of a block in units of ts; it decides how many tasks share a key, never a result.
    """
    if not order or order[0] != ts:
        raise ValueError("the order has to begin with the time column")
    values = {f"v_{name}": s.column for name, s in scans.items()}
    held = rows.withColumn("s_block", F.floor(F.col(ts) / F.lit(float(block))).cast("long")).withColumns(values)
    by = [*keys, "s_block"]
    before = Window.unboundedPreceding
    local, summary, carry = {}, [], {}
    place = F.struct(*order)
    w, blocks = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*keys).orderBy(F.col("s_block").asc_nulls_first())
    # What comes next is what came last the other way round: a frame that ends with the partition is worked out anew for each row.
    back, blocks_back = Window.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in order]), Window.partitionBy(*keys).orderBy(F.col("s_block").desc_nulls_last())
    for name, s in scans.items():
        c = F.col(f"v_{name}")
        frame = (back if s.kind == "next" else w).rowsBetween(before, 0 if s.own else -1)
        local[f"l_{name}"] = LOCAL[s.kind](c).over(frame)
        ends = {"last": F.max_by, "next": F.min_by}.get(s.kind)
        summary.append((ends(c, F.when(c.isNotNull(), place)) if ends else LOCAL[s.kind](c)).alias(f"b_{name}"))
        carry[f"c_{name}"] = LOCAL[s.kind](F.col(f"b_{name}")).over((blocks_back if s.kind == "next" else blocks).rowsBetween(before, -1))
    carried = held.groupBy(*by).agg(*summary).withColumns(carry).select(*[F.col(k).alias(f"k_{k}") for k in by], *carry)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in by))
    both = held.withColumns(local).join(carried, same, "left")
    return both.select(*rows.columns, *[_joined(s.kind, F.col(f"l_{name}"), F.col(f"c_{name}")).alias(name) for name, s in scans.items()])


def block_width(rows: DataFrame, ts: str, rows_per_block: int = 1_000_000) -> float:
    """A width at which the table's rows fill blocks of about that many, if they are spread evenly; from counts."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("low"), F.max(ts).alias("high")).first()
    span = float(s.high - s.low) if s.n and s.high is not None else 0.0
    return max(span / max(1.0, s.n / rows_per_block), 1e-6) if span > 0 else 1.0


def carry_forward(dense: DataFrame, keys: list[str], order: str, columns: list[str], block: float) -> DataFrame:
    """Last observation carried forward along `order`."""
    out = scan(dense, keys, order, [order], block, **{f"f_{c}": Scan("last", F.col(c)) for c in columns})
    return out.select(*[F.col(f"f_{c}").alias(c) if c in columns else F.col(c) for c in dense.columns])


def lagged(rows: DataFrame, keys: list[str], ts: str, order: list[str], block: float, first: str | None = None, **columns: str) -> DataFrame:
    """The values of the row before, null for the first: name=column. first: a column that tells whether it is the first."""
    out = scan(rows, keys, ts, order, block, l_row=Scan("last", F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), own=False))
    told = [F.col("l_row").isNull().alias(first)] if first else []
    return out.select(*rows.columns, *[F.col(f"l_row.{n}").alias(n) for n in columns], *told)


def with_island(rows: DataFrame, keys: list[str], ts: str, order: list[str], begins: Column, block: float, first: str | None = None) -> DataFrame:
    """island: how many rows up to this one begin a new one (the first of a key always does).

    first: the column that tells a key's first row, where a scan before has found it; it is dropped.
    """
    if first is None:
        first = "i_first"
        marked = scan(rows.withColumn("i_begins", F.coalesce(begins, F.lit(False))), keys, ts, order, block, i_any=Scan("last", F.lit(1), own=False))
        rows, begins = marked.withColumn(first, F.col("i_any").isNull()).drop("i_any"), F.col("i_begins")
    flagged = rows.withColumn("i_flag", (F.col(first) | F.coalesce(begins, F.lit(False))).cast("long")).drop(first, "i_begins")
    return scan(flagged, keys, ts, order, block, island=Scan("sum", F.col("i_flag"))).drop("i_flag")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: str, take: list[str], block: float, tolerance=None, forward: bool = True) -> DataFrame:
    """As-of left join over blocks: the earliest right row at or after left_ts (or the latest at or before), within tolerance.

    right_ts and the columns of `take` come as r_<name>, null without a match.
    """
    tie_type = right.schema[tie].dataType
    picked = F.struct(F.col(right_ts), *[F.col(c) for c in take])
    r = right.select(F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("l"), *keys, F.col(right_ts).alias("a_ts"), F.lit(1 if forward else 0).alias("a_side"), F.col(tie).alias("a_tie"), picked.alias("r"))
    l = left.select(F.struct("*").alias("l"), *keys, F.col(left_ts).alias("a_ts"), F.lit(0 if forward else 1).alias("a_side"), F.lit(None).cast(tie_type).alias("a_tie"), F.lit(None).cast(r.schema["r"].dataType).alias("r"))
    both = scan(l.unionByName(r), keys, "a_ts", ["a_ts", "a_side", "a_tie"], block, n=Scan("next" if forward else "last", F.col("r"), own=False))
    far = F.col(f"n.{right_ts}") - F.col("a_ts") if forward else F.col("a_ts") - F.col(f"n.{right_ts}")
    near = F.col("a_ts").isNotNull() if tolerance is None else far <= F.lit(tolerance)
    return both.where(F.col("l").isNotNull()).select("l.*", *[F.when(near, F.col(f"n.{c}")).alias(f"r_{c}") for c in [right_ts, *take]])
