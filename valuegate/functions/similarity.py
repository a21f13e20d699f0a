"""String similarity on pairs that were blocked before: Indel ratio, best-part ratio and token-set ratio, as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bits of one number standing for the places of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common / (len a + len b)."""
    total = len(a) + len(b)
    return 2 * common(a, b) / total if total else 1.0


def best_part(short: str, long: str) -> float:
    """The best ratio of the shorter text to a part of the longer one that is no longer than it; 1.0 if it lies inside."""
    if len(short) > len(long):
        short, long = long, short
    if short in long:
        return 1.0
    n, m = len(short), len(long)
    spans = {(max(0, e - n), min(e, m)) for e in range(1, m + n)}
    return max((ratio(short, long[a:b]) for a, b in spans if b > a), default=0.0)


def similarity(mention: str, value: str, parts: list[str]) -> float:
    """The mention against the value and its parts; a part shorter than the mention is compared as a whole only."""
    left = mention.lower().strip()
    best = 0.0
    if left:
        for part in (parts if len(parts) else [value]):
            right = part.lower().strip()
            if right:
                best = max(best, ratio(left, right), best_part(left, right) if len(right) >= len(left) else 0.0)
    return best


def token_set(a: str, b: str) -> float:
    """Ratios among the shared words and each side's shared and own words, the best of them; 1.0 if one side's words are all shared."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both = " ".join(sorted(one & two))
    left, right = (" ".join(filter(None, [both, " ".join(sorted(x - y))])) for x, y in ((one, two), (two, one)))
    if both and (left == both or right == both):
        return 1.0
    return max(ratio(left, right), ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0)


def _arrow(f):
    """A column function over Arrow batches, made when it is used: workers import this module without a session."""

    def column(*args: Column | str) -> Column:
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([f(*row) for row in zip(*series, strict=True)], dtype="float64")

        return F.pandas_udf(run, "double")(*args)

    return column


ratio_of = _arrow(ratio)
similarity_of = _arrow(similarity)
token_set_of = _arrow(token_set)
