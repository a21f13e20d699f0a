"""Benchmark decontamination by templates, which also finds questions whose numbers, names or units were exchanged.

Texts become templates. The windows of a benchmark item are as long as what must match of it: 13 tokens, or 80 % of a
shorter item, so one window that both sides share is evidence. A filter made of the benchmark's window hashes lets through
the document windows that may match; those meet the benchmark's windows in a hash join. Each text has a second template
whose names are plain folded words, so that a copy in another case is found as well; windows of one kind meet only their
like. Matches of one item along one offset are put together, and count only if the slots are consistent: one value of
the item stands for one value in the document throughout, and back, or at most a fifth of the slots differ from the item's.

A window that many items share (an instruction before every question) would bring each document that has it together with
all of them. Items that have the same such windows at the same places, and equal slots in the same places of them, form a
class: what a document holds of these windows is consistent with all items of a class or with none, so it meets the least
item alone, which stands for all, and ``members`` lists them. Whatever differs within a class is decided item by item: where
a document holds other windows of a member as well, or where its slots are not consistent but may be the item's for the
greater part. So nothing is lost by the classes, and ``expanded`` gives every item a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuegate.llm.storage import table, written
from valuegate.llm.templates import Templates, windows
from valuegate.llm.textvec import Words, batches, mix

#: A document is contaminated by an item if this many tokens in a row match, or this share of a shorter item.
ENOUGH, SHARE = 13, 0.8
#: An item of fewer tokens says too little amid a text: it is found where it is the whole document.
LEAST = 5
#: Bits of the filter for each window of the benchmark, and the bounds of its size; beyond, it lets more through, and the join still decides.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27

#: A window of more items than this is met by classes of items.
COMMON = 16

ITEMS = "item_id long, cased boolean, hash long, at int, tokens int, slots array<long>"


def window_sizes(tokens: np.ndarray) -> np.ndarray:
    """Tokens of the windows of items of so many tokens."""
    return np.where(tokens < LEAST, tokens, np.minimum(ENOUGH, np.ceil(SHARE * tokens - 1e-9))).astype(np.int64)


def _windows(texts: list[str | None], sizes: list[int], items: bool, bits: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """The windows of both templates of the texts: text, cased, hash, at, tokens and slots."""
    smallest = int(window_sizes(np.array([LEAST]))[0])
    for a, b in batches(texts):
        words = Words(texts[a:b], folded=True)
        for cased in (True, False):
            t = Templates(texts[a:b], cased, words)
            count = np.diff(t.bounds)
            for size in range(1, min(ENOUGH, int(count.max(initial=0))) + 1) if items else sizes:
                start, hashes = windows(t, size)
                hashes = hashes if cased else mix(hashes)
                n = count[t.text[start]]
                amid = (n >= LEAST) & (window_sizes(n) == size) if items else np.full(len(n), size >= smallest)
                # A short item and a text that is no more than it have hashes of their own kind.
                for kept, named in ((amid, hashes), ((n == size) & (size < LEAST), mix(hashes + np.uint64(1)))):
                    kept = np.flatnonzero(kept)
                    if bits is not None:
                        kept = kept[holds(bits, named[kept])]
                    if len(kept):
                        first = start[kept]
                        text = t.text[first]
                        slots = t.values[first[:, None] + np.arange(size)].view(np.int64)
                        yield {"text": text + a, "cased": np.full(len(first), cased), "hash": named[kept].view(np.int64), "at": first - t.bounds[text], "tokens": n[kept], "slots": slots}


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def _batch(ids: pa.Array, found: dict[str, np.ndarray], names: list[str]) -> pa.RecordBatch:
    size = found["slots"].shape[1]
    slots = pa.ListArray.from_arrays(np.arange(len(found["text"]) + 1, dtype=np.int32) * size, pa.array(found["slots"].reshape(-1)))
    columns = [ids.take(pa.array(found["text"])), pa.array(found["cased"]), pa.array(found["hash"]), pa.array(found["at"].astype(np.int32)), pa.array(found["tokens"].astype(np.int32)), slots]
    return pa.RecordBatch.from_arrays(columns, names)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of both templates of every item; items without words have none."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for found in _windows(frame.column("text").to_pylist(), [], True):
                yield _batch(frame.column("item_id"), found, ["item_id", "cased", "hash", "at", "tokens", "slots"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, ITEMS)


def window_filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bytes of the filter, and the sizes of the windows that the benchmark has: ``MOST_BITS`` and ``ENOUGH`` at most."""
    sizes = {r["n"]: r["c"] for r in items.groupBy(F.size("slots").alias("n")).agg(F.count("*").alias("c")).collect()}  # ENOUGH rows at most
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_EACH * sum(sizes.values())):
        size *= 2
    place = F.col("hash").bitwiseAND(size - 1)
    part = items.select((place / 8).cast("int").alias("byte"), F.pow(F.lit(2), place % 8).cast("int").alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in part.collect():  # MOST_BITS / 8 rows at most
        bits[r["byte"]] = r["bits"]
    return bits, sorted(sizes)


def classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows of items with ``common`` (whether more than ``COMMON`` items share it), and the classes of items: (item_id, class, n_items).

    ``class`` is the least item of those whose common windows are the same at the same places, with equal slots in the same places.
    Only classes of several items are listed.
    """
    held = items.groupBy("hash", "cased").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") > COMMON).select("hash", "cased", F.lit(True).alias("common"))
    known = written(items.join(held, ["hash", "cased"], "left").withColumn("common", F.col("common").isNotNull()), "window-kinds")
    each = known.filter("common and item_id is not null").select("item_id", "cased", "hash", "at", F.posexplode("slots").alias("place", "slot"))
    # Where the slot's value stands first in the item's common windows: equal for two items just when their slots agree in the same places.
    first = F.min(F.col("at") + F.col("place")).over(Window.partitionBy("item_id", "cased", "slot"))
    formed = each.withColumn("first", first).groupBy("item_id").agg(
        F.sort_array(F.collect_set(F.struct("cased", "at", "hash", "place", F.when(F.col("slot") == 0, -1).otherwise(F.col("first")).alias("first")))).alias("form")
    )
    told = written(formed.select("item_id", F.xxhash64("form").alias("one"), F.xxhash64(F.lit(1), "form").alias("two")), "item-forms")
    least = told.groupBy("one", "two").agg(F.min("item_id").alias("class"), F.count("*").alias("n_items")).filter("n_items > 1")
    return known, told.join(least, ["one", "two"]).select("item_id", "class", "n_items")


def members(benchmark: DataFrame) -> DataFrame:
    """(hash, cased, class, item_id): the items of every class, once for each of its windows that many items share."""
    known, classed = classes(item_windows(benchmark))
    return known.filter("common").select("item_id", "hash", "cased").distinct().join(classed, "item_id").select("hash", "cased", "class", "item_id")


def text_key(text: Column) -> Column:
    """What tells rows with different texts apart: 128 bits."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", expand: bool = False) -> DataFrame:
    """(id, key, item_id, cased, doc_token, matched, item_tokens, exchanged, n_items, hash, class): the items that each row's text holds; ``key`` is its ``text_key``.

    Where ``n_items`` is over 1, windows that many items share matched: the row stands for all ``members`` of its class. With
    ``expand`` there are no such rows, and each member has its own.
    """
    items = written(item_windows(benchmark), "item-windows")
    bits, sizes = window_filter(items)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keys = pa.StructArray.from_arrays([frame.column("id"), frame.column("key")], ["id", "key"])
            for found in _windows(frame.column("text").to_pylist(), sizes, False, bits):
                yield _batch(keys, found, ["row", "cased", "hash", "doc_at", "doc_tokens", "doc_slots"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), text.alias("text"))
    ours = rows.mapInArrow(run, f"row struct<id:{kind},key:binary>, cased boolean, hash long, doc_at int, doc_tokens int, doc_slots array<long>")
    ours = ours.select("row", "cased", "hash", "doc_at", "doc_slots")
    known, classed = classes(items)
    classed = written(classed, "item-classes")
    known = known.join(classed, "item_id", "left")
    by_class = F.col("common") & F.col("class").isNotNull()
    # Of a class its least item's common windows. Written, so that a join on a frequent window can be dealt out.
    theirs = written(
        known.filter(~by_class | (F.col("item_id") == F.col("class"))).select(
            "item_id", "cased", "hash", F.col("at").alias("item_at"), F.col("tokens").alias("item_tokens"), F.col("slots").alias("item_slots"), by_class.alias("by_class"), "class", "n_items"
        ),
        "window-classes",
    )
    met = ours.join(theirs, ["hash", "cased"]).filter(F.size("doc_slots") == F.size("item_slots"))
    met = written(met.withColumn("offset", F.col("doc_at") - F.col("item_at")).drop("item_at"), "met")
    own, through = met.filter("not by_class"), met.filter("by_class")
    pairs = F.size("slots")
    grouped = _judged(through, ["row", "class", "cased", "offset"], F.max("n_items"))
    # What is decided for each item of a class: where windows of its own match, and where slots are not consistent, but a fifth of them may differ.
    open_ = grouped if expand else grouped.filter(~F.col("consistent") & (pairs >= 5))
    place = ["row", "class", "item_id", "cased", "offset"]
    wanted = own.filter("class is not null").select(*place).union(open_.join(classed.drop("n_items"), "class").select(*place)).distinct()
    theirs = known.filter(by_class).select("item_id", "cased", "hash", F.col("at").alias("item_at"), F.col("tokens").alias("item_tokens"), F.col("slots").alias("item_slots"))
    held = through.select("row", "class", "cased", "offset", "hash", "doc_at", "doc_slots", (F.col("doc_at") - F.col("offset")).alias("item_at"))
    one = F.struct("row.key", F.coalesce(F.col("row.id").cast("string"), F.lit("")), F.col("row.id").isNull())  # a null id is met as well
    held, wanted = (f.withColumn("one", one) for f in (held, wanted))
    whole = wanted.drop("row").join(held, ["one", "class", "cased", "offset"]).join(theirs, ["item_id", "cased", "hash", "item_at"])
    names = ["row", "item_id", "cased", "offset", "hash", "doc_at", "doc_slots", "item_tokens", "item_slots"]
    single = _judged(own.select(*names).union(whole.select(*names)), ["row", "item_id", "cased", "offset"], F.lit(1).cast("long")).withColumn("class", F.lit(None).cast("long"))
    found = single.filter(F.col("consistent") | (F.col("exchanged") * 5 <= pairs))
    if not expand:
        found = found.unionByName(grouped.filter("consistent").withColumn("item_id", F.col("class")))
    return found.select("row.id", "row.key", "item_id", "cased", "doc_token", "matched", "item_tokens", "exchanged", "n_items", "hash", "class")


def _judged(met: DataFrame, keys: list[str], n_items: Column) -> DataFrame:
    """Windows that met, put together by ``keys``: one item at one place of one text, so a group is no larger than the item."""
    pair = F.filter(F.arrays_zip("item_slots", "doc_slots"), lambda s: s["item_slots"] != 0)
    one = met.withColumns({"size": F.size("doc_slots"), "slots": pair}).groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("doc_at", "size"))).alias("hits"), F.first("item_tokens").alias("item_tokens"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.max("hash").alias("hash"), n_items.alias("n_items")
    )
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def longest(acc: Column, hit: Column) -> Column:
        end = hit["doc_at"] + hit["size"]
        run = F.when(hit["doc_at"] <= acc["end"], acc["run"] + end - acc["end"]).otherwise(hit["size"])
        return F.struct(end.alias("end"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    pairs = F.size("slots")
    consistent = (F.size(F.array_distinct("slots.item_slots")) == pairs) & (F.size(F.array_distinct("slots.doc_slots")) == pairs)
    exchanged = F.size(F.filter("slots", lambda s: s["item_slots"] != s["doc_slots"]))
    return one.select(
        *keys, F.col("hits")[0]["doc_at"].alias("doc_token"), F.aggregate("hits", start, longest, lambda acc: acc["best"]).alias("matched"), "item_tokens", "slots", consistent.alias("consistent"), exchanged.alias("exchanged"), "hash", "n_items"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", expand: bool = False) -> DataFrame:
    """A row for each document and benchmark item that it holds: the document's id, item_id, doc_token (place of the match),
    matched, item_tokens, exchanged (slots with another value than the item's), n_items, hash, class.

    Where ``n_items`` is over 1, the document has windows that many items share, and the row stands for all ``members`` of the
    class: the item is the least, and the slots are held against it. A member of which other windows match there too has a row of
    its own besides. With ``expand`` every item has its own row, and ``n_items`` is 1.

    Null and empty texts match nothing. Rows that repeat an id are looked at each and give one row together; so do all rows
    with a null id, whose id is null again. An item under five template tokens is found only where it is the whole
    document. An empty benchmark, or one without words, gives no rows. Of several places the one with most matched tokens,
    then the first, is returned. Tokens are those of the template without names only where nothing else matches: in copies
    in another case, or of short items amid a sentence. Other columns are not read, whatever their names.
    """
    best = F.max_by(F.struct("doc_token", "matched", "item_tokens", "exchanged"), F.struct("cased", "matched", -F.col("doc_token")))
    shared = F.max(F.struct("n_items", "hash", "class"))
    found = matches(docs, benchmark, id_col, text_col, expand).groupBy("id", "item_id").agg(best.alias("b"), shared.alias("s"))
    return found.select(F.col("id").alias(id_col), "item_id", "b.*", "s.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), expand=True)
