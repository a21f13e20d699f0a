"""Token counts by a finite-state transducer compiled from the vocabulary (see ``transducer``)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.encoding import encoder
from valuegate.llm.pretokens import Pretokens, pieces, supported, unknown
from valuegate.llm.storage import table
from valuegate.llm.transducer import compiled

LIMIT = 2048


def special_strings(path: str) -> list[str]:
    import json

    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", ())]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and n_tokens of every row: narrow, one pass, no shuffle.

    Nulls and empty texts count 0. Texts of any length are counted whole: they are cut before white space, which no
    token crosses. Repeated rows give a row each; a null id is kept; other columns of ``docs`` are not read. ``path`` is
    a lower-casing word BPE file of the tokenizers library and must exist on every executor. Texts with a character
    that Python's Unicode tables do not know are counted by the library, whose tables are newer.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not supported(path):
            raise ValueError(f"{path} does not state the pre-token rule of this operator")
        machine = compiled(path)
        special = re.compile("|".join(map(re.escape, special_strings(path))) or r"(?!)")
        for batch in batches:
            texts, owner = [], []
            total = np.zeros(len(batch), np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                if unknown(text):
                    total[i] = len(encoder(path).library.encode(text, add_special_tokens=False).ids)
                    continue
                parts = special.split(text) if text else [""]
                total[i] += len(parts) - 1  # an added token's own string is one token
                texts += parts
                owner += [i] * len(parts)
            owner = np.array(owner, np.int64)
            for index, parts in pieces(texts):
                np.add.at(total, owner[index], machine.counts(Pretokens(parts), len(parts)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(total)], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
