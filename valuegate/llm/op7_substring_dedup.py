"""Removal of long word passages that occur more than once, by suffix automata of reference shards.

A window is ``SIZE`` words. Its anchor is its least hash of ``GRAM`` words, so equal windows have equal anchors, and windows
that follow each other mostly share one: a run of windows with one anchor, with the words it covers, is a passage. Only
passages whose anchor occurs more than once can hold a repeated window. Equal passages are put together first and count
as one of that weight; a shard of nothing but copies of one passage needs no automaton, for all its windows are repeated.
The other distinct passages, routed by anchor, are the reference shards: a task builds a shard's suffix automaton and
streams the shard's passages through it, and the matching statistics tell which windows occur twice. A shard is bounded:
where an anchor has more distinct passages than one may hold, they are cut finer, by a second anchor in another order
of the hashes, then a third, and at last into single windows; each level's pieces go through automata like the first's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.automaton import SuffixAutomaton
from valuegate.llm.blocks import runs
from valuegate.llm.storage import table, written
from valuegate.llm.textvec import Words, batches, mix, prefix_sums, span_hash

SIZE, GRAM = 35, 8
#: Distinct passages of a reference shard; more are cut finer.
SHARD_PASSAGES = 512
#: Anchors that cut passages, one finer than the other; after the last each window stands for itself.
LEVELS = 3
#: Words of an automaton, about: smaller shards are put together.
SHARD_WORDS = 20_000

_PLACE = np.uint64((1 << 28) - 1)
#: Start and number of windows of a passage in one number.
_SHIFT = 8


def anchors(grams: np.ndarray, level: int = 0) -> np.ndarray:
    """The place of each window's anchor: of the least of its grams in the level's order, the leftmost of equals."""
    order = mix(grams if not level else mix(grams + np.uint64(level)))
    least = (order & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, span = SIZE - GRAM + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return (least & _PLACE).astype(np.int64)


def passages(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of windows with one anchor: anchor, first window (word number), number of windows, and text."""
    n = len(words.hashes)
    empty = np.zeros(0, np.int64)
    if n < SIZE:
        return empty.view(np.uint64), empty, empty, empty
    grams = span_hash(prefix_sums(words.hashes), np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    place = anchors(grams)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = text[: n - SIZE + 1] == text[SIZE - 1 :]
    first = np.flatnonzero(inside)
    new = np.ones(len(first), bool)
    new[1:] = (place[first[1:]] != place[first[:-1]]) | (first[1:] != first[:-1] + 1)
    start = first[new]
    count = np.diff(np.append(np.flatnonzero(new), len(first)))
    return grams[place[start]], start, count, text[start]


def _digest(raw: bytes, starts: list[int], ends: list[int]) -> str:
    return hashlib.sha256(b" ".join([raw[a:b] for a, b in zip(starts, ends, strict=True)])).hexdigest()


def _scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each passage; and one for each document, with its words' number and digest."""
    for frame in frames:
        texts = frame.column("text").to_pylist()
        for a, b in batches(texts):
            words = Words(texts[a:b])
            anchor, start, count, text = passages(words)
            whole = span_hash(prefix_sums(words.hashes), start, start + count + (SIZE - 1))
            raw = words.bytes.tobytes()
            cuts = words.bounds.tolist()
            digests = [_digest(raw, words.starts[x:y].tolist(), words.ends[x:y].tolist()) for x, y in zip(cuts, cuts[1:], strict=False)]
            place = ((start - words.bounds[text]) << _SHIFT) | count
            own, none = frame.column("key").slice(a, b - a), np.zeros(b - a, np.int64)
            columns = [
                pa.concat_arrays([own.take(pa.array(text)), own]), pa.array(np.concatenate((anchor.view(np.int64), none))), pa.array(np.concatenate((whole.view(np.int64), none))),
                pa.array(np.concatenate((place, np.diff(words.bounds)))), pa.concat_arrays([pa.nulls(len(anchor), pa.string()), pa.array(digests, pa.string())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "anchor", "passage", "place", "digest"])


def _fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The word hashes of the wanted passages of each document."""
    for frame in frames:
        texts = frame["text"].tolist()
        for a, b in batches(texts):
            words = Words(texts[a:b])
            out: list[tuple] = []
            for i in range(a, b):
                base = int(words.bounds[i - a])
                for w in frame["wanted"].iloc[i]:
                    start, count = base + (w["place"] >> _SHIFT), w["place"] & 255
                    out.append((w["anchor"], w["passage"], w["weight"], words.hashes[start : start + count + SIZE - 1].astype("<u8").tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["anchor", "passage", "weight", "words"])


def _match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repeated windows of each distinct passage, as bits; the passages of several keys are put together to shards of bounded size."""
    for frame, starts in runs(frames, ["key"]):
        ends = [*starts[1:], len(frame)] if starts[-1] != len(frame) else starts[1:]
        tokens = [np.frombuffer(w, "<u8").tolist() for w in frame["words"]]
        weights = frame["weight"].tolist()
        bits: list[int] = []
        first = held = 0
        for begin, end in zip(starts, ends, strict=False):
            held += sum(map(len, tokens[begin:end]))
            if held >= SHARD_WORDS or end == ends[-1]:
                shard = SuffixAutomaton(tokens[first:end], weights[first:end])
                bits += [shard.repeated(t, SIZE) for t in tokens[first:end]]
                first, held = end, 0
        yield pd.DataFrame({"key": frame["key"].to_numpy(), "piece": frame["piece"].to_numpy(), "bits": np.array(bits, np.int64)})


def _finer(level: int):
    """Pieces cut at the level's anchors, or into windows at the last level."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for anchor, passage, weight, at, key, raw in frame[["anchor", "passage", "weight", "at", "key", "words"]].itertuples(index=False):
                hashes = np.frombuffer(raw, "<u8")
                sums, count = prefix_sums(hashes), len(hashes) - SIZE + 1
                starts = np.arange(count)
                if level < LEVELS:
                    place = np.arange(len(hashes) - GRAM + 1)
                    grams = span_hash(sums, place, place + GRAM)
                    place = anchors(grams, level)
                    first = np.flatnonzero(np.diff(place, prepend=-1))
                    named = grams[place[first]]
                else:
                    first, named = starts, span_hash(sums, starts, starts + SIZE)
                n = np.diff(np.append(first, count))
                keys = mix(named ^ mix(np.full(1, key, np.int64).view(np.uint64))).view(np.int64).tolist()
                pieces = span_hash(sums, first, first + n + SIZE - 1).view(np.int64).tolist()
                for f, m, k, piece in zip(first.tolist(), n.tolist(), keys, pieces, strict=True):
                    out.append((anchor, passage, weight, at + f, k, piece, raw[8 * f : 8 * (f + m + SIZE - 1)]))
            if out:
                yield pd.DataFrame(out, columns=["anchor", "passage", "weight", "at", "key", "piece", "words"])

    return run


PIECES = "anchor long, passage long, weight long, at int, key long, piece long, words binary"


def repeated_windows(examples: DataFrame) -> DataFrame:
    """(anchor, passage, bits): the repeated windows of each of the distinct passages (anchor, passage, weight, words), level by level."""
    rows = examples.select("anchor", "passage", "weight", F.lit(0).alias("at"), F.col("anchor").alias("key"), F.col("passage").alias("piece"), "words")
    done: DataFrame | None = None
    for level in range(1, LEVELS + 2):
        # Equal pieces count as one, whichever passages they come from; at the first level there are none.
        one = rows.groupBy("key", "piece").agg(F.sum("weight").alias("weight"), F.any_value("words").alias("words")) if level > 1 else rows.select("key", "piece", "weight", "words")
        crowded = written(one.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_PASSAGES).select("key"), "crowded-keys")
        few = one.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key", "piece")
        bits = written(few.mapInPandas(_match, "key long, piece long, bits long").filter("bits != 0"), "repeated-pieces")
        found = rows.join(bits, ["key", "piece"]).select("anchor", "passage", F.expr("shiftleft(bits, at)").alias("bits"))
        done = found if done is None else done.unionAll(found)
        if crowded.isEmpty():
            break
        rows = written(rows.join(crowded, "key", "left_semi").select("anchor", "passage", "weight", "at", "key", "words").mapInPandas(_finer(level), PIECES), "finer-pieces")
    # Pieces of a passage have windows of their own, so their bits add up.
    return done.groupBy("anchor", "passage").agg(F.sum("bits").alias("bits"))


def _remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, keys = frame["text"].tolist(), frame["key"].to_numpy()
        for a, b in batches(texts):
            words = Words(texts[a:b])
            raw = words.bytes.tobytes()
            removed, digests, kept_texts = [], [], []
            for i in range(a, b):
                lo, hi = int(words.bounds[i - a]), int(words.bounds[i - a + 1])
                edge = np.zeros(hi - lo + 1, np.int64)
                for w in frame["hits"].iloc[i]:
                    start, bits = w["place"] >> _SHIFT, w["bits"]
                    count = w["place"] & 255
                    at = start + (np.arange(count) if bits < 0 else np.flatnonzero(bits >> np.arange(count) & 1))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + SIZE, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = np.flatnonzero(keep) + lo
                parts = [raw[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)]
                text = b" ".join(parts)
                removed.append(hi - lo - len(kept))
                digests.append(hashlib.sha256(text).hexdigest())
                kept_texts.append(text.decode())
            yield pd.DataFrame({"key": keys[a:b], "n_removed": removed, "kept_sha256": digests, "kept_text": kept_texts})


def row_key(id_: Column, text: Column) -> Column:
    """What rows that agree in id and text share: 128 bits."""
    return F.unhex(F.md5(F.concat_ws("\x01", id_.isNull().cast("string"), id_.cast("string"), text)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 and, if ``texts``, kept_text: the kept words joined by spaces) of every row.

    A word goes if some window of 35 words that covers it occurs anywhere else in the input, the same document included.
    Null and empty texts have no words; documents under 35 words lose none; an empty table gives an empty one. Rows that
    repeat a whole row lose what they share with it and each give their row; a null id is kept; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), row_key(F.col(id_col), text).alias("key"))
    scanned = rows.select("key", "text").mapInArrow(_scan, "key binary, anchor long, passage long, place long, digest string")
    scanned = written(scanned, "passages")
    found = scanned.filter("digest is null").select("anchor", "passage", "key", "place")
    # Anchors that occur twice, and whether all their passages are equal. Written, so that a join on a frequent one can be dealt out.
    twice = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("passage").alias("low"), F.max("passage").alias("high"))
    twice = written(twice.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "repeated-anchors")
    candidates = written(found.join(twice, "anchor"), "candidate-passages")
    distinct = candidates.filter("mixed").groupBy("anchor", "passage").agg(F.count("*").alias("weight"), F.min(F.struct("key", "place")).alias("at"))
    distinct = written(distinct, "distinct-passages")
    # The words of one example of each distinct passage; a document's list is no longer than the document.
    wanted = distinct.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("anchor", "passage", "weight", F.col("at.place").alias("place"))).alias("wanted"))
    documents = candidates.select("key").distinct().join(wanted, "key", "left")
    one = rows.select("key", "text").join(documents, "key")
    held = written(one, "candidate-texts")
    examples = held.filter("wanted is not null").dropDuplicates(["key"]).mapInPandas(_fetch, "anchor long, passage long, weight long, words binary")
    bits = written(repeated_windows(written(examples, "example-passages")), "repeated-windows")
    # All windows of a passage: bits below 0.
    mixed = candidates.filter("mixed").join(bits, ["anchor", "passage"]).select("key", "place", "bits")
    hits = candidates.filter("not mixed").select("key", "place", F.lit(-1).cast("long").alias("bits")).unionByName(mixed)
    hits = hits.groupBy("key").agg(F.collect_set(F.struct("place", "bits")).alias("hits"))
    cut = held.select("key", "text").dropDuplicates(["key"]).join(hits, "key").mapInPandas(_remove, "key binary, n_removed long, kept_sha256 string, kept_text string")
    full = scanned.filter("digest is not null").select("key", F.col("place").alias("n_words"), "digest")
    if not texts:
        cut = cut.drop("kept_text")
    named = rows.select("id", "key").join(full.dropDuplicates(["key"]), "key").join(cut, "key", "left")
    out = [F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "digest").alias("kept_sha256")]
    if texts:
        plain = rows.select("key", F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ").alias("plain")).dropDuplicates(["key"])
        named = named.join(plain, "key")
        out.append(F.coalesce("kept_text", "plain").alias("kept_text"))
    return named.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
