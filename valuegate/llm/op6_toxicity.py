"""Toxic spans by a linear-chain conditional random field; its marginals give document scores and offending offsets.

The words are labelled from document labels: in toxic training documents, the words with a form or beginning that toxic
documents hold and clean ones hardly ever do. The field is trained on those words in all training texts, with the word,
its beginnings and both neighbours as features; a logistic curve over its marginals, fitted on training documents that
the field was not, turns them into a document score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm import crf
from valuegate.llm.storage import table
from valuegate.llm.textvec import Words, batches, mix, span_hash

#: Training documents of each label, at most, and bytes of their texts: the bounded sample that the classifier is fitted on.
SAMPLE, SAMPLE_BYTES = 2000, 4_000_000
#: Beginnings of words that are features, in bytes; 0 is the whole word.
HEADS = (0, 4, 5, 6)
#: A word's features: its own, and the whole words before and after it.
SLOTS = len(HEADS) + 2
#: A feature is known if so many training documents hold it.
LEAST_HELD = 5
#: A feature marks toxic words if this many toxic training documents hold it, and so many times as many as clean ones.
LEAST_DOCS, LEAST_RATIO = 3, 8.0
#: A word of a scored text belongs to a toxic span from this marginal on.
SPAN_AT = 0.5


@dataclass
class Model:
    keys: np.ndarray  # ascending hashes of the known features
    weights: np.ndarray  # theirs, and the bias
    initial: float
    transition: np.ndarray
    curve: np.ndarray  # of the document score

    def emission(self, words: Words) -> np.ndarray:
        """The score of state 1 at every word. What a word adds, to itself and to its neighbours, is looked up once a word form."""
        _, example, form = np.unique(words.hashes, return_index=True, return_inverse=True)
        weights = np.append(self.weights[:-1], 0.0)
        own = weights[lookup(self.keys, own_features(words, example))].sum(axis=1)
        before, after = (weights[lookup(self.keys, beside(words.hashes[example], side))] for side in (0, 1))
        score = own[form] + self.weights[-1]
        follows = follows_word(words.bounds, len(form))
        score[follows] += before[form[follows - 1]]
        score[follows - 1] += after[form[follows]]
        return score

    def tag(self, words: Words) -> np.ndarray:
        """The marginal of every word, the chain running through its whole text."""
        out = np.zeros(len(words.starts))
        if len(out):
            lie = crf.Segments(words.bounds)
            prob, _ = crf.marginals(self.emission(words), lie, self.initial, self.transition)
            out[lie.at[lie.inside]] = prob[lie.inside]
        return out

    def score(self, marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(marginal, bounds) @ self.curve, -30, 30)))


def follows_word(bounds: np.ndarray, n: int) -> np.ndarray:
    """The words that are not the first of their text."""
    follows = np.ones(n, bool)
    follows[bounds[:-1][np.diff(bounds) > 0]] = False
    return np.flatnonzero(follows)


def own_features(words: Words, which: np.ndarray) -> np.ndarray:
    """(word, head) of the chosen words: the hash of the whole word or of its first bytes; 0 where the word is no longer than those."""
    starts = words.starts[which]
    size = words.ends[which] - starts
    out = np.zeros((len(which), len(HEADS)), np.uint64)
    for k, head in enumerate(HEADS):
        if head:
            long = size > head
            out[long, k] = mix(span_hash(words.sums, starts[long], starts[long] + head) + np.uint64(head))
        else:
            out[:, k] = words.hashes[which]
    return out


def beside(hashes: np.ndarray, side: int) -> np.ndarray:
    """The features that words are to the word after them (side 0) or before them (side 1)."""
    return mix(hashes + np.uint64(101 + side))


def feature_hashes(words: Words) -> np.ndarray:
    """(word, slot): the features of every word; 0 where there is none."""
    n = len(words.starts)
    out = np.zeros((n, SLOTS), np.uint64)
    out[:, : len(HEADS)] = own_features(words, np.arange(n))
    follows = follows_word(words.bounds, n)
    out[follows, -2] = beside(words.hashes[follows - 1], 0)
    out[follows - 1, -1] = beside(words.hashes[follows], 1)
    return out


def lookup(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The features' numbers, -1 if unknown."""
    if not len(keys):
        return np.full(hashes.shape, -1)
    at = np.minimum(np.searchsorted(keys, hashes.reshape(-1)), len(keys) - 1)
    return np.where(keys[at] == hashes.reshape(-1), at, -1).reshape(hashes.shape)


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The feature hashes of all words of the texts, made batch by batch, and the texts' word bounds."""
    parts, counts = [np.zeros((0, SLOTS), np.uint64)], [np.zeros(1, np.int64)]
    for a, b in batches(texts):
        words = Words(texts[a:b], folded=True)
        parts.append(feature_hashes(words))
        counts.append(np.diff(words.bounds))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def summary(marginal: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: its greatest marginal, the expected number of toxic words, their share, and 1."""
    n = np.diff(bounds)
    sums = np.concatenate(([0.0], np.cumsum(marginal)))
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    most = np.zeros(len(n))
    some = n > 0
    if some.any():
        most[some] = np.maximum.reduceat(marginal, bounds[:-1][some])
    return np.stack([most, np.log1p(total), np.log1p(100 * total / np.maximum(n, 1)), np.ones(len(n))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], toxic: list[int], prior: float = 0.1) -> Model:
    """Train on labelled texts. ``prior`` is the share of toxic documents that the scores are calibrated to.

    With no text of one of the labels every score is the prior.
    """
    y = np.asarray(toxic, np.int64)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    flat = np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))])
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(0, np.uint64), np.zeros(1), 0.0, np.zeros((2, 2)), flat)
    # A third of the documents is kept for the curve, by turns within each label.
    turn = np.zeros(len(y), np.int64)
    for label in (0, 1):
        turn[y == label] = np.arange((y == label).sum()) % 3
    own, rest = np.flatnonzero(turn < 2), np.flatnonzero(turn == 2)
    hashes, bounds = _features([texts[i] for i in own])
    text = np.repeat(np.arange(len(own)), np.diff(bounds))
    # Documents of either label that hold each feature, one kind of feature at a time to spare memory.
    n1, n0 = max(1, int((y[own] == 1).sum())), max(1, int((y[own] == 0).sum()))
    known, marking = [], []
    for k in range(SLOTS):
        used = hashes[:, k] != 0
        names, number = np.unique(hashes[used, k], return_inverse=True)
        held = np.unique(number * len(own) + text[used])
        bad = y[own][held % len(own)]
        in1 = np.bincount(held // len(own), weights=bad, minlength=len(names))
        in0 = np.bincount(held // len(own), weights=1 - bad, minlength=len(names))
        marks = (in1 >= LEAST_DOCS) & (in1 / n1 >= LEAST_RATIO * (in0 + 0.5) / n0) & (k < len(HEADS))
        known.append(names[marks | (in1 + in0 >= LEAST_HELD)])
        marking.append(names[marks])
    keys, marking = np.unique(np.concatenate(known)), np.unique(np.concatenate(marking))
    labels = ((lookup(marking, hashes[:, : len(HEADS)]) >= 0).any(axis=1) & (y[own][text] == 1)).astype(np.int64)
    found = lookup(keys, hashes).astype(np.int32)
    del hashes
    weights, initial, transition = crf.fit(found, labels, bounds, len(keys))
    model = Model(keys, weights, initial, transition, flat)
    if len(rest):
        listed, rows = [texts[i] for i in rest], []
        for a, b in batches(listed):
            words = Words(listed[a:b], folded=True)
            rows.append(summary(model.tag(words), words.bounds))
        x = np.concatenate(rows)
        share = y[rest].mean()
        if 0 < share < 1:
            weight = np.where(y[rest] == 1, prior / share, (1 - prior) / (1 - share))
            model.curve = _logistic(x, y[rest].astype(np.float64), weight)
    return model


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from training; one without an id always is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` labelled documents and ``sample_bytes`` of text of each label that are not held out, chosen by a hash of the id.

    A text over an eighth of those bytes is no training text. A document with several labels is toxic if one says so; null
    labels and ids are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    first = lambda t: known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(first(1).unionByName(first(0)))  # at most 2 * sample rows of two numbers
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    # First the sizes alone, of one row for each id and text; so what is fetched is bounded in rows and in bytes.
    sizes = texts.select("doc_id", "key", F.octet_length("text").alias("size")).join(chosen, "doc_id").distinct()
    taken, left = [], {0: sample_bytes, 1: sample_bytes}
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(2 * sample).collect():
        if 8 * r["size"] <= sample_bytes and r["size"] <= left.get(r["toxic"], -1):
            left[r["toxic"]] -= r["size"]
            taken.append((r["doc_id"], r["key"], len(taken), r["toxic"]))
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, key long, place int, toxic int")
    rows = texts.join(F.broadcast(wanted), ["doc_id", "key"]).dropDuplicates(["place"]).select("place", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: r["place"])
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], 0.1 if share is None else share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, score, spans) of every row: narrow, one pass over whole texts; spans are (start, end, score) in characters.

    Null, empty and wordless texts have no spans and the score of no evidence. Rows that repeat give a row each; a null
    id is kept; other columns are not read.
    """

    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("text").to_pylist()
            for a, b in batches(texts):
                words = Words(texts[a:b], folded=True)
                marginal = model.tag(words)
                found: list[list[tuple[int, int, float]]] = [[] for _ in range(b - a)]
                hot = np.flatnonzero(marginal >= SPAN_AT) if spans else np.zeros(0, np.int64)
                if len(hot):
                    chars = np.concatenate(([0], np.cumsum((words.bytes & 0xC0) != 0x80)))
                    owner = np.searchsorted(words.bounds, hot, side="right") - 1
                    lengths = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts[a:b]])))
                    begin, end = chars[words.starts[hot]] - lengths[owner], chars[words.ends[hot]] - lengths[owner]
                    for k, i in enumerate(owner.tolist()):
                        here = found[i]
                        if k and hot[k] == hot[k - 1] + 1 and owner[k - 1] == i:
                            s, _, p = here[-1]
                            here[-1] = (s, int(end[k]), max(p, float(marginal[hot[k]])))
                        else:
                            here.append((int(begin[k]), int(end[k]), float(marginal[hot[k]])))
                scores = pa.array(model.score(marginal, words.bounds))
                yield pa.RecordBatch.from_arrays([frame.column("id").slice(a, b - a), scores, pa.array(found, span)], ["id", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, score double, spans array<struct<start:int,end:int,score:double>>")
    return out.withColumnRenamed("id", id_col)


def document_score(model: Model):
    """The document score as a column function of the text, for filters that keep all columns."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        listed = texts.tolist()
        parts = [np.zeros(0)]
        for a, b in batches(listed):
            words = Words(listed[a:b], folded=True)
            parts.append(model.score(model.tag(words), words.bounds))
        return pd.Series(np.concatenate(parts))

    return toxicity


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
