"""Token ids in the fewest bits: fixed-width packed blocks with offsets, unpacked by numpy.

The file format is a folder of Parquet files, one shard for each written partition; shards ascend with the document id.
A row is a block: ``shard``, ``block``, ``first`` (ids of the shard before it), ``bits``, ``low`` and ``high`` (least and greatest
document id), ``n_ids``, ``doc_ids``, ``doc_sizes`` and ``payload``. Id k of a block is the ``bits`` bits from bit ``k * bits`` on, lowest bit
first. A document's ids begin at the sum of the sizes before it, so any document, or any id of it, is reached by its
block's row alone; readers skip the other blocks by ``low`` and ``high`` or by the ids before them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuegate.llm.encoding import encoder
from valuegate.llm.storage import new_folder, table

BLOCK_IDS = 1 << 17
END_ID = 1
#: Ranges of document ids that a scan is told.
SPANS = 64
BLOCKS = "shard int, block int, first long, bits int, low long, high long, n_ids long, doc_ids array<long>, doc_sizes array<long>, payload binary"
SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("bits", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("payload", pa.binary())])


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    planes = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from id ``start`` on, touching only their own bytes."""
    at = start * bits + bits * np.arange(count, dtype=np.int64)
    raw = np.frombuffer(payload, np.uint8)
    low = int(at[0] >> 3) if count else 0
    part = np.concatenate((raw[low : ((start + count) * bits + 7) // 8], np.zeros(8, np.uint8)))
    byte = (at >> 3) - low
    word = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        word |= part[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, add ``end_id`` and write the packed shards to ``folder``.

    Null and empty texts have the end id alone; an empty table gives a folder without blocks. Rows ascend by id, nulls
    first; rows that share an id ascend by a hash of their text, so that a frequent id is dealt over several shards, and equal
    rows stay side by side. One shuffle of the texts; other columns are not read. Blocks close at ``BLOCK_IDS`` ids, a
    longer document has a block of its own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, shard = encoder(path), TaskContext.get().partitionId()
        bits = width(max(machine.library.get_vocab_size(), end_id + 1))
        block = first = held = 0
        names: list[int | None] = []
        parts: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            known = [n for n in names if n is not None]
            low, high = (min(known), max(known)) if known else (None, None)
            row = {
                "shard": shard, "block": block, "first": first, "bits": bits, "low": low, "high": high, "n_ids": held,
                "doc_ids": names, "doc_sizes": [len(p) for p in parts], "payload": pack(np.concatenate(parts), bits),
            }
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for batch in batches:
            keys = batch.column("id").to_pylist()
            for i, ids in machine.encode(batch.column("text").to_pylist()):
                if held and held + len(ids) + 1 > BLOCK_IDS:
                    yield closed()
                    block, first, held, names, parts = block + 1, first + held, 0, [], []
                names.append(keys[i])
                parts.append(np.append(ids, np.int32(end_id)))
                held += len(ids) + 1
        if held:
            yield closed()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "text").select("id", "text")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(folder)


def _placed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``before``: the ids of all shards before theirs. A shard's total is one row, and there are as many as partitions were written."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return blocks.join(F.broadcast(before), "shard")


def _documents(blocks: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """The documents of ``blocks``; ``wanted`` (ascending) only some of them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = None if wanted is None else set(wanted)
        for batch in batches:
            if wanted is not None:
                bounds = zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), strict=True)
                batch = batch.filter(pa.array([a is not None and bisect_left(wanted, a) < bisect_right(wanted, b) for a, b in bounds], pa.bool_()))
            for row in batch.to_pylist():
                sizes = np.asarray(row["doc_sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                take = [k for k, name in enumerate(row["doc_ids"]) if chosen is None or name in chosen]
                if chosen is None:
                    ids = unpack(row["payload"], row["bits"], 0, int(sizes.sum())).astype("<u4")
                    parts = [ids[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                else:
                    parts = [unpack(row["payload"], row["bits"], int(starts[k]), int(sizes[k])).astype("<u4").tobytes() for k in take]
                names = pa.array([row["doc_ids"][k] for k in take], pa.int64())
                begin = pa.array(row["before"] + row["first"] + starts[take], pa.int64())
                yield pa.RecordBatch.from_arrays([names, begin, pa.array(sizes[take], pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32 bits) of every document."""
    return _documents(_placed(read_blocks(spark, folder)))


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read_ids`` of some documents: only blocks whose range of ids holds one are unpacked, and of them only those documents.

    However many there are, the scan gets ``SPANS`` ranges of ids at most, cut at the widest gaps; each block then looks its own range up.
    """
    wanted = sorted({k for k in doc_ids if k is not None})
    gaps = sorted(sorted(range(1, len(wanted)), key=lambda i: wanted[i - 1] - wanted[i])[: SPANS - 1])
    spans = [(wanted[a], wanted[b - 1]) for a, b in pairwise([0, *gaps, len(wanted)])] if wanted else []
    within = reduce(Column.__or__, [(F.col("low") <= b) & (F.col("high") >= a) for a, b in spans], F.lit(False))
    return _documents(_placed(read_blocks(spark, folder)).filter(within), wanted)


def read_span(spark: SparkSession, folder: str, start: int, count: int) -> DataFrame:
    """(start, ids) of the blocks' parts of the ids from ``start`` on, ``count`` of them or as many as there are; document bounds do not matter."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin = row["before"] + row["first"]
                a, b = max(start, begin), min(start + count, begin + row["n_ids"])
                ids = unpack(row["payload"], row["bits"], a - begin, b - a).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([ids], pa.binary())], ["start", "ids"])

    begin = F.col("before") + F.col("first")
    hit = _placed(read_blocks(spark, folder)).filter((begin < start + count) & (begin + F.col("n_ids") > start))
    return hit.mapInArrow(decode, "start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "packed-ids")
    write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    docs = read_ids(spark, folder)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
