"""Packing of documents into training windows by the online sum-of-squares rule.

The state is a level array: how many open windows stand at each fill level. A document goes to the level that makes the
sum of the squared counts smallest, over all levels it fits in and a new window. Only documents longer than a window
are cut up front. At a partition's end no new window can be filled any more: the emptiest window is taken apart, again
and again, and its pieces are placed by the same rule in the open windows that are left, cut where none has room. The
last window's rest is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.encoding import encoder
from valuegate.llm.storage import table

WINDOW = 4096
END_ID = 2
#: Ids in open windows (4 bytes each) at which a task closes them all, as at its end, and begins anew: its memory is bounded.
OPEN_IDS = 1 << 24
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

Piece = tuple[object, int, int, np.ndarray]  # document, ids of it before, all its ids' count, ids


class SumOfSquares:
    """Packs pieces of at most ``window`` ids. ``add`` and ``drain`` give the sequences that became full, as lists of pieces."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.held, self.moved = window, 0, 0
        self.level = np.zeros(window + 1, np.int64)
        self.stacks: dict[int, deque[list[Piece]]] = {}

    def choose(self, size: int, fresh: bool = True) -> int:
        """The level whose window takes ``size`` more ids with the least sum of squared counts; ties: the fullest.

        0 is a new window or, if there may be none, no room.
        """
        room = self.window - size
        here, after = self.level[1 : room + 1], self.level[1 + size :]
        change = 2 * (after - here) + 2
        if room:
            change[-1] = 1 - 2 * here[-1]  # becomes full and leaves the array
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        most = 2 * int(self.level[size]) + 1 if fresh else np.iinfo(np.int64).max - 1
        if not len(change) or change.min() > most:
            return 0
        return len(change) - int(change[::-1].argmin())

    def _take(self, level: int) -> list[Piece]:
        self.level[level] -= 1
        self.held -= level
        return self.stacks[level].popleft()

    def _put(self, held: list[Piece], level: int, piece: Piece) -> Iterator[list[Piece]]:
        held.append(piece)
        filled = level + len(piece[3])
        if filled == self.window:
            yield held
            return
        self.stacks.setdefault(filled, deque()).append(held)
        self.level[filled] += 1
        self.held += filled

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        if len(piece[3]) == self.window:
            yield [piece]
            return
        level = self.choose(len(piece[3]))
        yield from self._put(self._take(level) if level else [], level, piece)

    def drain(self) -> Iterator[list[Piece]]:
        """Everything that is open: full windows, then one sequence for each power of two in the rest."""
        while self.level.sum() > 1:
            for doc, start, total, ids in self._take(int(np.flatnonzero(self.level)[0])):
                self.moved += len(ids)
                while len(ids):
                    level = self.choose(len(ids), fresh=False)
                    if not level and self.level.any():
                        # No room for the whole: a cut fills a window, and the sum falls most where most windows stand.
                        level = self.window - int(self.level[::-1].argmax())
                    part = ids[: self.window - level]
                    yield from self._put(self._take(level) if level else [], level, (doc, start, total, part))
                    start, ids = start + len(part), ids[len(part) :]
        for level in np.flatnonzero(self.level).tolist():
            waiting, left = deque(self._take(level)), level
            while left:
                need = 1 << (left.bit_length() - 1)
                left -= need
                held = []
                while need:
                    doc, start, total, ids = waiting.popleft()
                    held.append((doc, start, total, ids[:need]))
                    if len(ids) > need:
                        waiting.appendleft((doc, start + need, total, ids[need:]))
                    need -= len(held[-1][3])
                yield held


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence, and its ids (binary, little-endian, 32 bits).

    Narrow: each input partition packs its own documents, in its own order, so there is no shuffle and a repeated task
    gives the same rows. ``window`` is a power of two. Null and empty texts have the end id alone; repeated rows are
    packed each; an empty table gives no rows; other columns are not read. Only windows that are open are held in memory.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, rule = encoder(path), SumOfSquares(window)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0

        def laid(sequences: Iterator[list[Piece]]) -> None:
            nonlocal number, held
            for pieces in sequences:
                offset = 0
                for doc, start, total, ids in pieces:
                    rows.append((doc, start, len(ids), total, number, offset, ids.astype("<u4").tobytes()))
                    offset += len(ids)
                held += offset
                number += 1

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            keys = batch.column("id").to_pylist()
            for i, ids in machine.encode(batch.column("text").to_pylist()):
                ids = np.append(ids, np.int32(end_id))
                for start in range(0, len(ids), window):
                    laid(rule.add((keys[i], start, len(ids), ids[start : start + window])))
                if rule.held > OPEN_IDS:
                    laid(rule.drain())
                if held > 1 << 21:
                    yield out()
                    rows.clear()
                    held = 0
        laid(rule.drain())
        if rows:
            yield out()

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows_in.mapInArrow(pack, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
