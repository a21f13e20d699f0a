"""Chat formatting: conversations as training strings, put together byte by byte in columns.

A batch of turns is two Arrow buffers, of roles and of texts. The lengths of all segments (marks, escaped roles, escaped texts) give
cumulative offsets; marks and contents are then scattered by index into one buffer of the final size, which becomes the Arrow
column without another copy. Reading back works the same way in the other direction.

A turn is ``<turn>`` role ``<text>`` text ``</turn>`` and a line end. Inside roles and texts a backslash is doubled, and a control string
gets one behind its first character: it then occurs nowhere literally, so no tokenizer takes it for a mark, and dropping
each escaping backslash restores the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.conversations import batched, by_conversation, in_order, ordered, pieces, runs
from valuegate.llm.storage import table

#: Bytes that are scattered at a time; bounds the index arrays.
STRIDE = 1 << 20
_ESCAPE = ord("\\")
#: The conversation that every run of the query adds: control strings inside texts.
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


@dataclass(frozen=True)
class Template:
    """Marks around a turn's role and text, further ``controls`` to be escaped, and the roles whose texts are trained on.

    All control strings begin with a character that none of them holds elsewhere, and hold no backslash: so no two overlap,
    and none can come about where a text meets a mark.
    """

    begin: str = "<turn>"
    middle: str = "<text>"
    end: str = "</turn>"
    controls: tuple[str, ...] = ("<|endoftext|>", "<|im_start|>", "<|im_end|>")
    trained: tuple[str, ...] = ("assistant",)
    after: str = "\n"
    marks: tuple[bytes, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = tuple(m.encode() for m in (self.begin, self.middle, self.end, *self.controls))
        first = marks[0][0]
        if any(len(m) < 2 or m[0] != first or first in m[1:] or _ESCAPE in m for m in marks) or first >= 0x80 or any(a != b and a in b for a in marks for b in marks):
            raise ValueError("control strings share a first character that they hold nowhere else, and hold no backslash and no other control string")
        object.__setattr__(self, "marks", marks)


DEFAULT = Template()


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets into them, nulls as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _occurrences(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` begins in ``data``."""
    at = np.flatnonzero(data == mark[0])
    for k in range(1, len(mark)):
        at = at[at + k < len(data)]
        at = at[data[at + k] == mark[k]]
    return at


def _insertions(data: np.ndarray, offsets: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """Ascending positions of ``data`` that an escape goes before."""
    found = [np.flatnonzero(data == _ESCAPE)]
    for mark in marks:
        at = _occurrences(data, mark)
        row = np.searchsorted(offsets, at, "right") - 1
        found.append(at[at + len(mark) <= offsets[row + 1]] + 1)  # not across the end of a text
    return np.sort(np.concatenate(found))


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray, escapes: np.ndarray) -> None:
    """Row k of ``data`` goes to ``out`` from ``starts[k]`` on, with its escapes."""
    before = np.searchsorted(escapes, offsets[:-1])  # escapes of earlier rows
    shift = starts - offsets[:-1] - before
    for low in range(0, len(data), STRIDE):
        high = min(low + STRIDE, len(data))
        a, b = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
        sizes = np.minimum(offsets[a + 1 : b + 1], high) - np.maximum(offsets[a:b], low)
        mine = escapes[np.searchsorted(escapes, low) : np.searchsorted(escapes, high)]
        gone = np.zeros(high - low, np.int64)
        np.add.at(gone, mine - low, 1)
        to = np.arange(low, high) + np.repeat(shift[a:b], sizes) + np.cumsum(gone) + np.searchsorted(escapes, low)
        out[to] = data[low:high]
        out[to[mine - low] - 1] = _ESCAPE


def _stamp(out: np.ndarray, starts: np.ndarray, mark: bytes) -> None:
    out[starts[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each turn begins and the last ends, where its text begins, where its text ends) of whole turns."""
    role, role_at = _buffer(roles)
    text, text_at = _buffer(texts)
    role_in, text_in = _insertions(role, role_at, template.marks), _insertions(text, text_at, template.marks)
    grown = lambda at, escapes: np.diff(at) + np.diff(np.searchsorted(escapes, at))
    n, begin, middle, end = len(roles), template.begin.encode(), template.middle.encode(), (template.end + template.after).encode()
    sizes = np.stack((np.full(n, len(begin)), grown(role_at, role_in), np.full(n, len(middle)), grown(text_at, text_in), np.full(n, len(end))), axis=1)
    bounds = np.concatenate(([0], np.cumsum(sizes.reshape(-1))))
    at = bounds[:-1].reshape(n, 5)
    buffer = pa.allocate_buffer(int(bounds[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for k, mark in ((0, begin), (2, middle), (4, end)):
        _stamp(out, at[:, k], mark)
    _scatter(out, at[:, 1], role, role_at, role_in)
    _scatter(out, at[:, 3], text, text_at, text_in)
    return buffer, bounds[::5], at[:, 3], at[:, 4]


def _characters(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and all of them."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


FORMATTED = "conv_id long, part long, whole boolean, formatted string, loss array<struct<start: long, end: long>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, part, whole, formatted, loss): one row a conversation; a conversation that crosses a partition or 4 MB is several parts, in order.

    ``loss`` are the spans of ``formatted`` (code points, end exclusive) that are trained on: the texts of the trained roles,
    empty ones too. Rows go by turn, nulls first; rows of one turn go by role and text. A null role or text is empty; rows without
    a conversation id are one conversation of id null; equal rows are turns of their own; an empty table gives no row. Other
    columns are not read. One shuffle.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turns, starts, parts, whole in runs(batches):
            roles = turns.column("role").combine_chunks()
            buffer, bounds, low, high = assemble(roles, turns.column("text").combine_chunks(), template)
            places = bounds[starts]
            characters = _characters(np.frombuffer(buffer, np.uint8))
            spans = np.flatnonzero(pc.is_in(roles, value_set=pa.array(template.trained)).to_numpy(zero_copy_only=False))
            owner = np.searchsorted(starts, spans, "right") - 1
            base = characters[places[owner]]
            loss = pa.StructArray.from_arrays([pa.array(characters[at[spans]] - base) for at in (low, high)], ["start", "end"])
            formatted = pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(places.astype(np.int64)), buffer)
            yield pa.RecordBatch.from_arrays(
                [
                    turns.column("conv_id").combine_chunks().take(pa.array(starts[:-1])), pa.array(parts), pa.array(whole), formatted.cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(spans, starts), pa.int32()), loss).cast(_LOSS),
                ],
                ["conv_id", "part", "whole", "formatted", "loss"],
            )

    return ordered(rows, "conv_id", "turn", "role", "text").mapInArrow(make, FORMATTED)


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ascending spans without their escapes, one after another, and the spans' offsets there."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(offsets[-1]), np.uint8)
    for low in range(0, len(out), STRIDE):
        high = min(low + STRIDE, len(out))
        a, b = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
        each = np.minimum(offsets[a + 1 : b + 1], high) - np.maximum(offsets[a:b], low)
        out[low:high] = data[np.arange(low, high) + np.repeat(starts[a:b] - offsets[a:b], each)]
    # Of a row of backslashes every other one escapes, from the first on. A row never crosses a span's end.
    slash = np.flatnonzero(out == _ESCAPE)
    new = np.ones(len(slash), bool)
    new[1:] = np.diff(slash) > 1
    new |= np.isin(slash, offsets)
    run = np.maximum.accumulate(np.where(new, np.arange(len(slash)), 0))
    drop = slash[(np.arange(len(slash)) - run) % 2 == 0]
    keep = np.ones(len(out), bool)
    keep[drop] = False
    return out[keep], offsets - np.searchsorted(drop, offsets)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of a list column of spans, and its starts and ends."""
    offsets = column.offsets.to_numpy()
    inner = column.flatten()
    return offsets - offsets[0], *(inner.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))


def parse(formatted: pa.Array, template: Template) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(turns before each string and all of them, roles, texts) with roles and texts as bytes and offsets; only the marks are looked for."""
    data, bounds = _buffer(formatted)
    begin, middle, end = (_occurrences(data, m) for m in template.marks[:3])
    roles = _cut(data, begin + len(template.marks[0]), middle)
    texts = _cut(data, middle + len(template.marks[1]), end)
    return np.searchsorted(begin, bounds), roles, texts


def trained_text(formatted: pa.Array, loss: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(spans before each string and all of them, the unescaped texts under the mask as bytes and offsets)."""
    data, bounds = _buffer(formatted)
    count, starts, ends = _spans(loss)
    owner = np.repeat(np.arange(len(formatted)), np.diff(count))
    characters = _characters(data)
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each code point begins
    base = characters[bounds[:-1]][owner]
    return count, _cut(data, byte[base + starts], byte[base + ends])


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def read_turns(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, part, place, role, text): the turns of formatted conversations, unescaped. Narrow."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches if b.num_rows for piece in pieces(b)):
            count, roles, texts = parse(batch.column("formatted"), template)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(count))
            place = np.arange(len(owner)) - count[:-1][owner]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(owner)), batch.column("part").take(pa.array(owner)), pa.array(place), _strings(*roles), _strings(*texts)], ["conv_id", "part", "place", "role", "text"])

    return formatted.select("conv_id", "part", "formatted").mapInArrow(read, "conv_id long, part long, place long, role string, text string")


def _interleaved(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of role, line end, text and line end of every turn, and where each turn begins."""
    sizes = np.stack((np.diff(roles[1]), np.ones(len(roles[1]) - 1, np.int64), np.diff(texts[1]), np.ones(len(texts[1]) - 1, np.int64)), axis=1)
    bounds = np.concatenate(([0], np.cumsum(sizes.reshape(-1))))
    at = bounds[:-1].reshape(-1, 4)
    out = np.full(int(bounds[-1]), ord("\n"), np.uint8)
    none = np.zeros(0, np.int64)
    _scatter(out, at[:, 0], *roles, none)
    _scatter(out, at[:, 2], *texts, none)
    return out, bounds[::4]


PARTS = "conv_id long, part long, n_turns long, turns_sha256 string, turns binary, loss_chars long, loss_sha256 string, loss binary, formatted_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and digests of every conversation, read back from its formatted parts.

    A conversation in one part is digested where it is read; only the bytes of others move, and are digested in order as they come.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches if b.num_rows for piece in pieces(b)):
            strings, whole = batch.column("formatted"), batch.column("whole").to_pylist()
            count, roles, texts = parse(strings, template)
            turns, at = _interleaved(roles, texts)
            spans, (loss, loss_at) = trained_text(strings, batch.column("loss"))
            data, bounds = _buffer(strings)
            characters, trained = _characters(data), _characters(loss)
            names = {"conv_id": batch.column("conv_id").to_pylist(), "part": batch.column("part").to_pylist()}
            rows = []
            for k, one in enumerate(whole):
                row = {c: v[k] for c, v in names.items()} | {"n_turns": int(count[k + 1] - count[k]), "loss_chars": int(trained[loss_at[spans[k + 1]]] - trained[loss_at[spans[k]]]), "formatted_chars": int(characters[bounds[k + 1]] - characters[bounds[k]])}
                for name, own in (("turns", turns[at[count[k]] : at[count[k + 1]]]), ("loss", loss[loss_at[spans[k]] : loss_at[spans[k + 1]]])):
                    row |= {f"{name}_sha256": hashlib.sha256(own).hexdigest()} if one else {name: own.tobytes()}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_PARTS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, parts in by_conversation(batches):
            sums, row = {k: hashlib.sha256() for k in ("turns", "loss")}, {"conv_id": conv, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            for part in parts:
                row |= {k: row[k] + part[k] for k in ("n_turns", "loss_chars", "formatted_chars")}
                for k, s in sums.items():
                    s.update(part[k] or b"")
                    row[f"{k}_sha256"] = part[f"{k}_sha256"] or s.hexdigest()
            yield row

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(joined(batches), _DIGESTS)

    return in_order(formatted.mapInArrow(read, PARTS), "conv_id", "part").mapInArrow(join, DIGESTS)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


_PARTS, _DIGESTS = _schema(PARTS), _schema(DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digests(format_conversations(given.unionByName(planted)))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        out = f"replace({column}, {quote(chr(92))}, {quote(chr(92) * 2)})"
        for mark in DEFAULT.marks:
            out = f"replace({out}, {quote(mark.decode())}, {quote(mark.decode()[0] + chr(92) + mark.decode()[1:])})"
        return out

    fixed = len(DEFAULT.begin + DEFAULT.middle + DEFAULT.end + DEFAULT.after)
    planted = ", ".join(f"({c}, {t}, {quote(r)}, {quote(x)})" for c, t, r, x in PLANTED)
    return f"""
WITH rows AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {planted}),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({fixed} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars
FROM filled GROUP BY conv_id"""


ORACLE_SQL = _oracle()
