"""Pairs inside buckets, compared block against block: a bucket is dealt over blocks of bounded size, and every pair of blocks is one unit.

No pair becomes a row: a unit's rows meet in one task as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegate.llm.components import each_with


def dealt(members: DataFrame, sizes: DataFrame, key: str, row: str, blocks: str) -> DataFrame:
    """``members`` of the buckets in ``sizes``, once for each unit (``low``, ``high``) that its block takes part in.

    ``sizes`` has ``key`` and the number of blocks; a member's block is a hash of its ``row``, so no rank within a bucket is needed.
    """
    joined = each_with(members, sizes, key)
    own = joined.withColumn("own", F.pmod(F.xxhash64(row), F.col(blocks)).cast("int"))
    unit = F.transform(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    return own.withColumn("unit", F.explode(unit)).select("*", "unit.low", "unit.high").drop("unit", blocks)


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames made of whole runs of rows with equal ``keys``, and where each run begins (and the last ends).

    The rows come sorted by ``keys``; a run cut by the end of a batch waits for the next one.
    """
    import numpy as np

    held: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        new = np.zeros(len(frame), bool)
        new[0] = True
        for k in keys:
            column = frame[k].to_numpy()
            new[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            whole = frame.iloc[: starts[-1]]
            yield whole, starts.tolist()
        held = frame.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, [0, len(held)]
