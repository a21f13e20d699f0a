"""Near-duplicate documents by BagMinHash: weighted-Jaccard signatures of shingle multisets, bands, exact verification.

A document is the multiset of its five-word shingles. Every shingle carries Poisson processes over its discretised
weight: one for the levels below 1, one each for [1, 2), [2, 4), [4, 8) and so on, at a rate of the interval's length,
split in halves down to single levels as far as its points matter. A point has a time and a signature component, drawn
from hashes of shingle and interval; it counts if its level is below the shingle's weight in the document. A component
keeps its earliest point, so two documents agree in a component with probability of exactly their weighted Jaccard
similarity. A process stops once it is later than all components of its document.

Documents that agree in a band are candidates. Texts with equal words are one class from the start, told apart by over 100
bits of hashes. Each bucket's members are first verified against its least one; buckets that then still hold several
components are compared block against block. At similarity 0.8 a pair shares none of 25 bands of 4 with probability 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.blocks import dealt, runs
from valuegate.llm.components import components, each_with, named, stars
from valuegate.llm.storage import table, written
from valuegate.llm.textvec import Words, batches, grams, mix

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 4
#: Bounds of a block: documents, and words.
BLOCK_DOCS, BLOCK_WORDS = 256, 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def multisets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Of all texts together: the text, the shingle hash (ascending within a text) and its count; and the words."""
    words = Words(texts, folded=True)
    hashes, bounds = grams(words.hashes, words.bounds, SHINGLE)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], hashes[first], np.diff(np.append(first, len(hashes))), words


def _waits(seed: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate 1."""
    return -np.log1p(-((seed >> np.uint64(11)).astype(np.float64) * 2.0**-53))


def signatures(text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_texts: int, size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures of weighted sets; weights are positive whole numbers. A text without elements has infinities.

    A process over more than one level is known by its first point alone. It is split in halves: one has that point, the
    other draws a later one. So a half that lies above the weight, or whose first point is too late, is never looked into.
    """
    sig = np.full((n_texts, size), np.inf)
    flat = sig.reshape(-1)
    # The processes of each element: level intervals [0, 1), [1, 2), [2, 4) ... that begin below its weight.
    parts = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(hashes)), parts)
    interval = np.arange(len(element)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(interval > 0, 2.0 ** (interval - 1), 0.0)
    wide = np.where(interval > 0, low, 1.0)
    seed = mix(mix(hashes[element] + interval.astype(np.uint64) * _ODD) + _ODD)
    doc, weight = text[element], weights[element].astype(np.float64)
    time = _waits(seed) / wide
    while len(seed):
        alive = (time < sig.max(axis=1)[doc]) & (low < weight)
        seed, time, doc, weight, low, wide = (v[alive] for v in (seed, time, doc, weight, low, wide))
        single, several = np.flatnonzero(wide == 1), np.flatnonzero(wide > 1)
        component = (mix(seed[single] ^ _ODD) % np.uint64(size)).astype(np.int64)
        np.minimum.at(flat, doc[single] * size + component, time[single])
        # A process of one level goes on to its next point; a wider one becomes its halves.
        following = mix(seed[single] + _ODD)
        half = wide[several] / 2
        upper = (mix(seed[several] ^ _ODD) & np.uint64(1)).astype(bool)
        first, second = mix(seed[several] + _ODD), mix(seed[several] + _ODD + _ODD)
        later = time[several] + _waits(second) / half
        rest = np.concatenate((single, several, several))
        doc, weight = doc[rest], weight[rest]
        time = np.concatenate((time[single] + _waits(following), time[several], later))
        low = np.concatenate((low[single], low[several] + half * upper, low[several] + half * ~upper))
        wide = np.concatenate((wide[single], half, half))
        seed = np.concatenate((following, first, second))
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    values = sig.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(sig), bands, -1)
    key = np.zeros(values.shape[:2], np.uint64)
    for r in range(values.shape[2]):
        key = mix(key + values[:, :, r] * _ODD + np.uint64(r + 1))
    return key.view(np.int64)


def _sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts = frame.column("text").to_pylist()
        for a, b in batches(texts):
            text, hashes, weights, words = multisets(texts[a:b])
            keys = band_keys(signatures(text, hashes, weights, b - a))
            sizes = np.diff(words.bounds)
            whole, _ = grams(words.hashes, words.bounds, max(1, int(sizes.max(initial=1))))
            identity = np.zeros(b - a, np.uint64)
            identity[sizes > 0] = whole
            folded = np.bincount(text, weights=(hashes >> np.uint64(32)).astype(np.float64), minlength=b - a).astype(np.int64)
            bands = pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * BANDS, pa.array(keys.reshape(-1)))
            own = [frame.column(c).slice(a, b - a) for c in ("id", "key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(identity.view(np.int64)), pa.array(folded), pa.array(sizes.astype(np.int64)), bands], ["id", "key", "word_key", "word_key2", "n_words", "bands"])


def similarities(texts: list[str], others: list[str], which: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of text i with ``others[which[i]]``; 0 where the sizes alone keep it under the threshold."""
    doc, hashes, counts, _ = multisets(texts)
    odoc, ohashes, ocounts, _ = multisets(others)
    own = np.bincount(doc, weights=counts, minlength=len(texts))
    its = np.bincount(odoc, weights=ocounts, minlength=len(others))[which]
    near = np.minimum(own, its) >= (THRESHOLD - 1e-9) * np.maximum(own, its)
    near &= own > 0
    # The other side's elements, once for each text that they are compared with.
    bounds = np.searchsorted(odoc, np.arange(len(others) + 1))
    size = np.where(near, np.diff(bounds)[which], 0)
    pair = np.repeat(np.arange(len(texts)), size)
    take = np.repeat(bounds[:-1][which] - (np.cumsum(size) - size), size) + np.arange(len(pair))
    mine = near[doc]
    pair, keys, n = np.concatenate((doc[mine], pair)), np.concatenate((hashes[mine], ohashes[take])), np.concatenate((counts[mine], ocounts[take]))
    order = np.lexsort((keys, pair))
    pair, keys, n = pair[order], keys[order], n[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (keys[1:] == keys[:-1]))
    common = np.bincount(pair[both], weights=np.minimum(n[both], n[both + 1]), minlength=len(texts))
    return common / np.maximum(own + its - common, 1)


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the pairs whose similarity reaches the threshold."""
    for frame in frames:
        texts = frame["text_a"].tolist()
        hit = np.zeros(len(frame), bool)
        for a, b in batches(texts):
            _, first, which = np.unique(frame["b"].to_numpy()[a:b], return_index=True, return_inverse=True)
            hit[a:b] = similarities(texts[a:b], frame["text_b"].iloc[a + first].tolist(), which) >= THRESHOLD
        yield frame.loc[hit, ["a", "b"]]


def _join_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each unit of two blocks: links that tie together what the unit's texts are not known to be tied by yet."""
    for frame, starts in runs(frames, ["bucket", "low", "high"]):
        ends = [*starts[1:], len(frame)] if starts[-1] != len(frame) else starts[1:]
        found: list[tuple[int, int]] = []
        for lo, hi in zip(starts, ends, strict=False):
            part = frame.iloc[lo:hi]
            comp = part["component"].to_numpy(np.int64).copy()
            if hi - lo < 2 or (comp == comp[0]).all():
                continue
            ids, own = part["node"].to_numpy(np.int64), part["own"].to_numpy()
            same = part["low"].iloc[0] == part["high"].iloc[0]
            doc, hashes, counts, _ = multisets(part["text"].tolist())
            total = np.bincount(doc, weights=counts, minlength=len(ids))
            _, number = np.unique(hashes, return_inverse=True)
            bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
            have = np.zeros(number.max(initial=0) + 1, np.int64)
            for q in range(len(ids)):
                other = comp != comp[q]
                if not same:
                    other &= own != own[q]
                if not other.any():
                    continue
                mine = slice(bounds[q], bounds[q + 1])
                have[number[mine]] = counts[mine]
                common = np.bincount(doc, weights=np.minimum(have[number], counts), minlength=len(ids))
                have[number[mine]] = 0
                near = other & (common / np.maximum(total + total[q] - common, 1) >= THRESHOLD)
                for x in np.flatnonzero(near):
                    if comp[x] != comp[q]:
                        found.append((ids[q], ids[x]))
                        comp[comp == comp[x]] = comp[q]
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def row_key(id_: Column, text: Column) -> Column:
    """What rows that agree in id and text share: 128 bits."""
    return F.unhex(F.md5(F.concat_ws("\x01", id_.isNull().cast("string"), id_.cast("string"), F.coalesce(text, F.lit("")))))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, group_id, kept) for every row of ``docs``, as ``near_duplicates``; ``key`` is the row's ``row_key``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = rows.mapInArrow(_sign, "id long, key binary, word_key long, word_key2 long, n_words long, bands array<long>")
    signed = written(signed, "signatures")
    # One node a class of equal texts; the row of the least id stands for it.
    same = ["word_key", "word_key2", "n_words"]
    top = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("top")
    classes = signed.filter("n_words > 0").groupBy(*same).agg(top, F.any_value("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "text-classes")
    members = classes.select("node", "n_words", F.posexplode("bands").alias("band", "key")).select("node", "n_words", F.xxhash64("band", "key").alias("bucket"))
    buckets = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("n_words").alias("words"), F.min("node").alias("leader"), F.max("node").alias("last"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    )
    # Buckets of the same members, from several bands, are one.
    buckets = buckets.filter("n > 1").groupBy("n", "words", "leader", "last", "mark").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "words", "leader")
    # Written, so that a join on a frequent bucket can be dealt out.
    buckets = written(buckets, "buckets")
    members = written(members.join(buckets, "bucket"), "members")
    pairs = members.filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    # The nodes grow with the corpus and are never broadcast, so the texts are joined alike at every size.
    wanted = members.select("node").distinct().join(classes.select("node", F.col("top.key").alias("key")), "node").hint("merge")
    texts = written(rows.select("key", "text").join(wanted, "key").groupBy("node").agg(F.any_value("text").alias("text")), "candidate-texts")
    of = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    links = written(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(_verify, "a long, b long"), "leader-links")
    # What the leaders did not settle: buckets of three or more texts in several components.
    tied = stars(links)
    placed = members.filter("n > 2").join(named(tied), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.first("n").alias("n"), F.first("words").alias("words")).filter("first != last")
    open_ = open_.select("bucket", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("words") / BLOCK_WORDS)).alias("blocks"))
    units = dealt(placed.select("node", "bucket", "component"), open_, "bucket", "node", "blocks").join(texts, "node")
    more = (
        units.repartition("bucket", "low", "high")
        .sortWithinPartitions("bucket", "low", "high", "node")
        .select("bucket", "low", "high", "own", "node", "component", "text")
        .mapInPandas(_join_up, "a long, b long")
    )
    # The stars stand for the leaders' links, so only what the blocks add takes further rounds.
    every = components(tied.unionAll(written(more, "block-links")))
    tops = every.join(classes.select("node", "top"), "node").groupBy("component").agg(F.min("top").alias("first"))
    firsts = each_with(every, tops, "component").select("node", "first")
    known = classes.select(*same, "node", "top").join(firsts, "node", "left").select(*same, F.coalesce("first", "top").alias("first"))
    # Texts without words are of no class and stand for themselves.
    joined = signed.select("id", "key", *same).join(written(known, "text-groups"), same, "left")
    alone = F.col("first").isNull()
    kept = alone | ((F.col("key") == F.col("first.key")) & F.col("id").eqNullSafe(F.col("first.id")))
    return joined.select("id", "key", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("group_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, kept) for every row of ``docs``: the group is the component of links at similarity 0.8 or more,
    named by its least id, and the document of that id is kept.

    Words are folded: lower case, ASCII signs divide them. Texts of 1 to 4 words are one shingle; texts without words
    (null, empty, signs only) link with nothing and are kept. Rows that share an id are documents of their own if their
    texts differ; of those with the group's least id the first by a digest is kept. Rows that repeat id and text are alike in
    all. A row with a null id belongs to the group of its text and stands for it only if no other row has an id; the
    group's id is then null. An empty table gives an empty one. Other columns are not read.
    """
    return groups(docs, id_col, text_col).select(F.col("id").alias(id_col), "group_id", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
