"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, distributed components.

Equal vectors of one label are one node that counts as many as have it. Nodes of one label that agree in all signs of some
table meet, as blocks in numpy; no pair becomes a row. Buckets with the same members, from several tables, are compared
once, and a pair that meets again counts in the first table that brings it together. At cosine 0.98 a sign differs with
probability 0.064, so with 24 tables of 16 signs a pair at the threshold is missed with probability 3e-5, and closer
pairs less often.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegate.llm.blocks import dealt, runs
from valuegate.llm.components import components, each_with
from valuegate.llm.storage import table, written
from valuegate.llm.textvec import mix

TABLES, SIGNS = 24, 16
THRESHOLD = 0.98
SEED = 20_240_501
#: Vectors of a bucket that one block holds; a larger bucket is dealt over several blocks.
BLOCK = 512


def signatures(vectors: np.ndarray, tables: int = TABLES, signs: int = SIGNS) -> np.ndarray:
    """Sign patterns, one number a table. The planes hang on the vectors' length alone, so every task draws the same."""
    planes = np.random.default_rng(SEED + vectors.shape[1]).standard_normal((vectors.shape[1], tables * signs))
    positive = (vectors @ planes > 0).reshape(len(vectors), tables, signs)
    return (positive @ (1 << np.arange(signs))).astype(np.uint16)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; without overflow in the squares."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _encoded(kind: str):
    """Vectors as bytes, null if they cannot link, and a digest of what makes two of them one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, classes, dims = [], [], []
            for vector, label, ok in zip(batch.column("embedding"), batch.column("label").to_pylist(), batch.column("ok").to_pylist(), strict=True):
                x = vector.values.to_numpy(zero_copy_only=False).astype(kind) if ok else np.zeros(0)
                if len(x) and np.isfinite(x).all() and x.any():
                    data = x.tobytes()
                    raw.append(data)
                    dims.append(len(x))
                    classes.append(hashlib.blake2b(repr(label).encode() + b"\0" + data, digest_size=16).digest())
                else:
                    raw.append(None)
                    dims.append(0)
                    classes.append(None)
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(classes, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "class", "dim", "vector"])

    return run


def _signed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = batch.column("vector").to_pylist(), batch.column("dim").to_numpy()
            signs = np.zeros((len(raw), TABLES), np.uint16)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                signs[at] = signatures(unit(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tobytes() for s in signs], pa.binary())], [*batch.schema.names, "signs"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table of each node: its bucket."""
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.uint16).reshape(-1, TABLES).astype(np.uint64)
        group = batch.column("group").to_numpy().view(np.uint64)
        number = np.arange(TABLES, dtype=np.uint64)
        bucket = mix(mix(group[:, None] + number) + signs)
        node = np.repeat(batch.column("node").to_numpy(), TABLES)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.tile(number.astype(np.int32), len(group))), pa.array(bucket.reshape(-1).view(np.int64))], ["node", "number", "bucket"])


def _compare(kind: str):
    """Of each unit of two blocks: how many links each node has in it, and the least node that links tie it to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in runs(frames, ["group", "number", "bucket", "low", "high"]):
            n = len(frame)
            nodes, weights = frame["node"].to_numpy(np.int64), frame["weight"].to_numpy(np.float64)
            own, low, high, number = (frame[c].to_numpy() for c in ("own", "low", "high", "number"))
            vectors, signs = frame["vector"].tolist(), frame["signs"].tolist()
            links, least = np.zeros(n, np.int64), nodes.copy()
            for a, b in zip(starts, [*starts[1:], n] if starts[-1] != n else starts[1:], strict=False):
                if b - a < 2:
                    continue
                x = unit(np.frombuffer(b"".join(vectors[a:b]), kind).reshape(b - a, -1))
                left = np.flatnonzero(own[a:b] == low[a])
                right = left if low[a] == high[a] else np.flatnonzero(own[a:b] == high[a])
                near = x[left] @ x[right].T >= THRESHOLD
                if right is left:
                    np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                i, j, t = left[i], right[j], int(number[a])
                if t:  # an earlier table has compared those that agree there
                    sig = np.frombuffer(b"".join(signs[a:b]), np.uint16).reshape(b - a, -1)[:, :t]
                    fresh = ~(sig[i] == sig[j]).any(axis=1)
                    i, j = i[fresh], j[fresh]
                w = weights[a:b]
                links[a:b] += np.bincount(i, weights=w[j], minlength=b - a).astype(np.int64)
                if right is not left:
                    links[a:b] += np.bincount(j, weights=w[i], minlength=b - a).astype(np.int64)
                part = least[a:b]
                while True:
                    before = part.copy()
                    np.minimum.at(part, i, before[j])
                    np.minimum.at(part, j, before[i])
                    if (part == before).all():
                        break
            hit = links > 0
            yield pd.DataFrame({"node": nodes[hit], "links": links[hit], "least": least[hit]})

    return run


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of one label that is not null are compared; vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. A null id gives a row that links with
    nothing. Rows that repeat an id with another vector or label are vectors of their own, each with its own links; rows
    that repeat all three count once and get the same result. An empty table gives an empty one. Other columns are not read.
    """
    element = vectors.schema["embedding"].dataType.elementType
    precision, kind = ("float", "<f4") if isinstance(element, T.FloatType) else ("double", "<f8")
    label = vectors.schema["label"].dataType.simpleString()
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    ok = F.coalesce(good & ~F.exists("embedding", lambda c: c.isNull()), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(f"array<{precision}>").alias("embedding")).withColumn("ok", ok)
    encoded = rows.mapInArrow(_encoded(kind), f"vec_id long, label {label}, class binary, dim int, vector binary")
    light = written(encoded.select("vec_id", "class"), "vector-rows")
    # One node a class of equal vectors; copies are put together before the shuffle.
    usable = light.filter("class is not null").distinct().groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    one = encoded.filter("class is not null").groupBy("class").agg(F.any_value(F.struct("label", "dim", "vector")).alias("v"))
    nodes = usable.join(one, "class").select("class", "rep", "weight", F.xxhash64("v.label", "v.dim").alias("group"), "v.dim", "v.vector", F.monotonically_increasing_id().alias("node"))
    nodes = written(nodes.mapInArrow(_signed(kind), "class binary, rep long, weight long, group long, dim int, vector binary, node long, signs binary"), "vectors")
    # Buckets first without their vectors: those of one member go before anything large is moved.
    members = written(nodes.select("node", "group", "signs").mapInArrow(_members, "node long, number int, bucket long"), "memberships")
    crowded = written(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = written(members.join(crowded, "bucket"), "bucket-members")
    same = members.groupBy("bucket").agg(F.first("n").alias("n"), F.first("number").alias("number"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"))
    kept = same.groupBy("n", "low", "high", "mark").agg(F.min(F.struct("number", "bucket")).alias("b")).select("b.bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    met = dealt(members.drop("n"), kept, "bucket", "node", "blocks").join(nodes.select("node", "group", "weight", "vector", "signs"), "node")
    keys = ["group", "number", "bucket", "low", "high"]
    compared = met.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "own", "node", "weight", "vector", "signs").mapInPandas(_compare(kind), "node long, links long, least long")
    compared = written(compared, "vector-links")
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    found = components(compared.select(F.col("node").alias("a"), F.col("least").alias("b")))
    small = nodes.select("node", "class", "rep", "weight")
    names = found.join(small, "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = each_with(found, names, "component").select("node", "least")
    known = small.join(counts, "node", "left").join(named, "node", "left")
    known = known.select("class", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("least")).filter("n_links > 0")
    joined = light.join(known, "class", "left")
    component = F.coalesce("least", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
