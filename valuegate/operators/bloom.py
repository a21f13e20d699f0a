"""A Bloom filter that travels with the texts: built by an aggregate, then one binary constant that expressions test.

It only says what cannot be there, so whatever passes is still looked up; a full or crowded filter costs rows, never results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes for each key, and what a filter may take at most: it is sent with every task.
BYTES_EACH, LEAST_BYTES, MOST_BYTES = 2.5, 64, 4 << 20
HASHES = 3
#: A byte holds so many bits that it reads as one ASCII character, which is how an expression gets at its value.
BITS = 7


def _places(key: Column, size: int) -> list[tuple[Column, Column]]:
    """(byte, bit) of every hash, from the halves of a 64-bit key."""
    one, two = F.shiftrightunsigned(key, 33), key.bitwiseAND(0x7FFFFFFF)
    return [((one + i * two) % size, F.shiftrightunsigned(two, 9 * i) % BITS) for i in range(HASHES)]


@dataclass(frozen=True)
class Bloom:
    data: bytes

    def may_hold(self, key: Column) -> Column:
        """Whether a 64-bit hash may be among the keys; false is certain. ``key`` is worked out once."""

        def held(k: Column) -> Column:
            out = F.lit(True)
            for byte, bit in _places(k, len(self.data)):
                value = F.ascii(F.substring(F.lit(self.data), (byte + 1).cast("int"), F.lit(1)).cast("string"))
                out = out & (F.getbit(value, bit.cast("int")) == 1)
            return out

        return F.exists(F.array(key), held)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """``may_hold`` of many keys (unsigned), inside an Arrow function."""
        data = np.frombuffer(self.data, np.uint8)
        one, two = keys >> np.uint64(33), keys & np.uint64(0x7FFFFFFF)
        out = np.ones(len(keys), bool)
        for i in range(HASHES):
            bit = (two >> np.uint64(9 * i)) % np.uint64(BITS)
            out &= data[(one + np.uint64(i) * two) % np.uint64(len(data))] >> bit.astype(np.uint8) & 1 > 0
        return out

    @property
    def share(self) -> float:
        """The share of bits that are set; its third power is about how often a key that is not there passes."""
        return float(np.unpackbits(np.frombuffer(self.data, np.uint8)).sum()) / (BITS * len(self.data))


def build(keys: DataFrame, column: str = "key", most_bytes: int = MOST_BYTES) -> Bloom:
    """The filter of a column of 64-bit hashes. Bytes are put together where the keys are, so the driver gets one row a byte at most."""
    n = keys.select(F.count("*")).first()[0]
    size = int(min(max(LEAST_BYTES, BYTES_EACH * n), most_bytes))
    place = F.explode(F.array(*(F.struct(byte.cast("int").alias("byte"), bit.cast("int").alias("bit")) for byte, bit in _places(F.col(column), size)))).alias("p")
    held = keys.select(place).groupBy("p.byte").agg(F.bit_or(F.pow(F.lit(2), F.col("p.bit")).cast("int")).alias("bits"))
    data = np.zeros(size, np.uint8)
    found = held.toArrow()
    data[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return Bloom(data.tobytes())
