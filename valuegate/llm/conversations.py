"""Conversations as sorted runs of rows, cut where a partition or a bound of size ends them, and put together again in order.

Rows are dealt by ranges of (conversation, turn, content), so a conversation that holds a large share of all rows lies in many
partitions. A part is a run of one conversation's rows inside a partition; ``whole`` says that it is all of its conversation.
Parts of a conversation ascend with ``part``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A part is closed when it holds so many bytes or rows.
PART_BYTES, PART_ROWS, PIECE_BYTES = 4 << 20, 1 << 15, 8 << 20
_EDGE = 64


def ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``rows`` sorted by conversation and turn (nulls first), rows of one turn by role and text; equal rows may be dealt apart.

    One shuffle. No key is longer than an edge of the text and its hash, so that the sampled bounds stay small.
    """
    keys = {"_edge": F.left(F.col(text), F.lit(_EDGE)), "_hash": F.xxhash64(text), "_place": F.monotonically_increasing_id()}
    by = [conv, turn, role, *keys]
    return rows.withColumns(keys).repartitionByRange(*by).sortWithinPartitions(*by).drop(*keys)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of ``PIECE_BYTES`` or a single row: what is made of a slice, arrays of indices too, is some times its size."""
    if batch.num_rows < 2 or batch.nbytes <= PIECE_BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half))
        yield from pieces(batch.slice(half))


def batched(rows: Iterable[dict], schema: pa.Schema, many: int = 1000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, many)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def _changes(ids: pa.Array) -> np.ndarray:
    """Where a run of equal ids begins."""
    known, values = pc.is_valid(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    new = np.ones(len(ids), bool)
    new[1:] = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    return np.flatnonzero(new)


def runs(batches: Iterator[pa.RecordBatch], conv: str = "conv_id") -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, where each part begins and the last ends, part numbers, whole) from a sorted partition; a batch's last run waits for the next batch."""
    held: pa.Table | None = None
    base, parts = TaskContext.get().partitionId() << 32, 0
    edge = True  # the next run may have begun before this partition, or its first part went out already

    def closed(rows: pa.Table, starts: np.ndarray, last_is_open: bool) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        nonlocal parts, edge
        whole = np.ones(len(starts), bool)
        whole[0], whole[-1] = not edge, whole[-1] and not last_is_open and (len(starts) > 1 or not edge)
        names = base + parts + np.arange(len(starts))
        parts, edge = parts + len(starts), last_is_open
        return rows, np.append(starts, rows.num_rows), names, whole

    for batch in (piece for b in batches if b.num_rows for piece in pieces(b)):
        new = pa.Table.from_batches([batch])
        rows = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        starts = _changes(rows.column(conv).combine_chunks())
        if len(starts) > 1:
            yield closed(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1], False)
        held = rows.slice(starts[-1]).combine_chunks()
        if held.num_rows >= PART_ROWS or held.nbytes >= PART_BYTES:
            yield closed(held, np.zeros(1, np.int64), True)
            held = None
    if held is not None:
        yield closed(held, _changes(held.column(conv).combine_chunks()), True)


def in_order(parts: DataFrame, conv: str, part: str) -> DataFrame:
    """Parts of a conversation side by side and in order, for a pass that holds one part at a time."""
    return parts.repartition(conv).sortWithinPartitions(conv, part)


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation with its parts in order, read as they come; one batch is in memory, never a whole conversation."""
    return groupby((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["conv_id"])
