"""Sequential work on hot keys in many tasks: rows in ordered blocks, and folds over them.

A fold goes over the rows of a key in order and carries a state: no window function can express it, and
one task per key would make the longest recording the longest task. Here the rows are range-partitioned
by key and order, so that a long key spans many blocks, and each block is folded at once:

1. Every block folds its first key from an empty state, on speculation (further keys begin in the block).
2. Where that key began in an earlier block, the state that block ended with is handed over. Both folds,
   from the empty and from the handed-over state, run side by side until they agree; from there on
   nothing of the first pass changes. Only blocks whose incoming state has changed are looked at, until none has.
3. A last pass folds every block once more, from its true state, and gives out the rows.

Folds that forget (the state depends on the latest rows only) settle in one hand-over, whatever the
number of blocks. One that remembers everything still gives right rows, a block per hand-over, in which
each block is folded a bounded number of times.
The driver sees a state per block (of at most MOST_BLOCKS), never rows. Numbers that count along a key
are no part of the state: they are added up over the blocks, like a prefix sum.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vodlens.plans.session import checkpointed, ship_package

ROWS_PER_BLOCK, MOST_BLOCKS = 200_000, 10_000
#: Rounds of hand-over in which all blocks take part whose state has changed.
TOGETHER = 2


class Fold:
    """A fold: its state, a step for each row and what is left at the end of a key.

    step and close return rows as (before, after, values): the key's running number grows by `before`,
    is put at `number_at` of the values (if that is set), and then grows by `after`.
    """

    number_at: int | None = None

    def reset(self) -> None:
        """The state before the first row of a key."""
        raise NotImplementedError

    def get(self):
        """The state, as a value that pickles and compares."""
        raise NotImplementedError

    def set(self, state) -> None:
        raise NotImplementedError

    def mark(self):
        """A small value that is equal where states are equal; states are only compared where it is."""
        return None

    def step(self, *row) -> list[tuple[int, int, tuple]]:
        raise NotImplementedError

    def close(self) -> list[tuple[int, int, tuple]]:
        return []


def in_blocks(rows: DataFrame, keys: list[str], order: list[str], rows_per_block: int = ROWS_PER_BLOCK, late: dict[str, Column] | None = None) -> DataFrame:
    """rows with `block`, sorted by keys and order within it; blocks follow each other in that order.

    late: columns that are computed when the rows are dealt, once; finding the blocks' bounds computes all others a second time.
    The result is checkpointed: a block is the same rows in every pass.
    """
    n = rows.count()
    blocks = max(1, min(MOST_BLOCKS, -(-n // rows_per_block)))
    dealt = rows.repartitionByRange(blocks, *keys, *order).sortWithinPartitions(*keys, *order)
    return checkpointed(dealt.withColumns({**(late or {}), "block": F.spark_partition_id()}))


@dataclass
class End:
    """What the driver knows of a block."""

    first: tuple
    last: tuple
    single: bool  # the block holds one key
    state: bytes
    number: int  # how far the last key's number went in this block


def values(c: pa.Array) -> list:
    """to_pylist(), faster for numbers and for repeated texts."""
    if not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type)):
        return c.to_numpy(zero_copy_only=False).tolist()
    if not c.null_count and pa.types.is_string(c.type):
        coded = c.dictionary_encode()
        return list(map(coded.dictionary.to_pylist().__getitem__, coded.indices.to_numpy().tolist()))
    return c.to_pylist()


def read(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, tuple]]:
    """Key and row of each row (block, keys, columns)."""
    for batch in batches:
        for row in zip(*map(values, batch.columns[1:])):
            yield row[:keys], row[keys:]


def packed(state) -> bytes:
    return zlib.compress(pickle.dumps(state), 1)


def unpacked(state: bytes):
    return pickle.loads(zlib.decompress(state))


def grown(out: list[tuple[int, int, tuple]]) -> int:
    return sum(before + after for before, after, _ in out) if out else 0


SEEN = "block int, first binary, last binary, single boolean, state binary, number long"


def _ends(rows: DataFrame, fold: Fold, keys: int) -> dict[int, End]:
    """Every block folded on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first, now, number, single = None, None, None, 0, True

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for batch in batches:
                if batch.num_rows:
                    block = batch.column(0)[0].as_py()
                    yield batch

        for key, row in read(noted(), keys):
            if first is None or key != now:
                single = first is None
                first = key if first is None else first
                now, number = key, 0
                fold.reset()
            number += grown(fold.step(*row))
        if first is not None:
            cells = [block, pickle.dumps(first), pickle.dumps(now), single, packed(fold.get()), number]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], [c.strip().split(" ")[0] for c in SEEN.split(",")])

    found = rows.mapInArrow(run, SEEN).collect()
    return {r.block: End(pickle.loads(r.first), pickle.loads(r.last), r.single, bytes(r.state), r.number) for r in found}


def _handed(rows: DataFrame, fold: Fold, keys: int, old: dict[int, bytes | None], new: dict[int, bytes]) -> dict[int, tuple[bytes | None, int]]:
    """Blocks of one key folded from their new state, until they agree with the fold from the old one.

    Gives the end state (None: as before) and how much the number's growth has changed.
    """
    sent = rows.sparkSession.sparkContext.broadcast((old, new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        before, after = sent.value
        a, b, block, change, met = copy.deepcopy(fold), copy.deepcopy(fold), None, 0, False
        for batch in batches:
            for row in zip(*map(values, batch.columns)):
                if block is None:
                    block = row[0]
                    a.reset()
                    if before[block] is not None:
                        a.set(unpacked(before[block]))
                    b.set(unpacked(after[block]))
                change += grown(b.step(*row[1 + keys :])) - grown(a.step(*row[1 + keys :]))
                if a.mark() == b.mark() and a.get() == b.get():
                    met = True
                    break
            if met:
                break
        if block is not None:
            cells = [block, None if met else packed(b.get()), change]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, (pa.int32(), pa.binary(), pa.int64()))], ["block", "state", "number"])

    found = rows.where(F.col("block").isin(sorted(new))).mapInArrow(run, "block int, state binary, number long").collect()
    return {r.block: (None if r.state is None else bytes(r.state), r.number) for r in found}


def settled(rows: DataFrame, fold: Fold, keys: int) -> tuple[dict[int, bytes], dict[int, int], set[int], int]:
    """Each block's true incoming state and number (where its first key began before), the blocks whose last key ends there, and the rounds of hand-over."""
    ends = _ends(rows, fold, keys)
    order = sorted(ends)
    follows = {b: a for a, b in zip(order, order[1:]) if ends[a].last == ends[b].first}
    used: dict[int, bytes | None] = {b: None for b in order}
    rounds = 0
    while True:
        incoming = {b: ends[a].state for b, a in follows.items()}
        changed = {b: s for b, s in incoming.items() if ends[b].single and used[b] != s}
        if not changed:
            break
        if rounds >= TOGETHER:  # this fold does not forget: a block waits until the one before has its true state
            changed = {b: s for b, s in changed.items() if follows[b] not in changed}
        rounds += 1
        for b, (state, number) in _handed(rows, fold, keys, used, changed).items():
            ends[b].number += number
            if state is not None:
                ends[b].state = state
        used.update(changed)
    numbers: dict[int, int] = {}
    for b in order:
        if b in follows:
            a = follows[b]
            numbers[b] = ends[a].number + (numbers.get(a, 0) if ends[a].single else 0)
    closing = set(order) - set(follows.values())
    return incoming, numbers, closing, rounds


def folded(rows: DataFrame, keys: list[str], order: list[str], take: list[str], fold: Fold, schema: str, rows_per_block: int = ROWS_PER_BLOCK, late: dict[str, Column] | None = None) -> DataFrame:
    """The rows that a fold gives out: keys, then its values. take: the columns that a step gets, late: those computed in the blocks from a column of that name (in_blocks)."""
    spark = rows.sparkSession
    ship_package(spark)
    held = in_blocks(rows.select(*dict.fromkeys([*keys, *take, *order])), keys, order, rows_per_block, late).select("block", *keys, *take)
    sent = spark.sparkContext.broadcast(settled(held, fold, len(keys))[:3])
    out_schema = T.StructType.fromDDL(schema)
    names = [f.name for f in out_schema]
    arrow = to_arrow_schema(out_schema)
    n_keys, at = len(keys), fold.number_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        incoming, numbers, closing = sent.value
        block, now, number, out = None, None, 0, []

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal block
            for batch in batches:
                if batch.num_rows:
                    block = batch.column(0)[0].as_py()
                    yield batch

        def put(given: list[tuple[int, int, tuple]]) -> None:
            nonlocal number
            for before, after, values in given:
                number += before
                out.append((*now, *(values if at is None else (*values[:at], number, *values[at:]))))
                number += after

        def full() -> pa.RecordBatch:
            cells = [pa.array(c, t) for c, t in zip(zip(*out), arrow.types)]
            out.clear()
            return pa.RecordBatch.from_arrays(cells, names)

        for key, row in read(noted(), n_keys):
            if now is None or key != now:
                if now is not None:
                    put(fold.close())
                fold.reset()
                number = 0
                if now is None and block in incoming:
                    fold.set(unpacked(incoming[block]))
                    number = numbers[block]
                now = key
            put(fold.step(*row))
            if len(out) >= 10_000:
                yield full()
        if now is not None and block in closing:
            put(fold.close())
        if out:
            yield full()

    return held.mapInArrow(run, schema)
