"""A Bloom filter over the hashes of a table, built by Spark and of bounded size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, at least and at most; bits for each of its entries within that, and those that tell of one.
LEAST_BITS, MOST_BITS, BITS_EACH, PROBES = 1 << 16, 1 << 26, 16, 4


class Filter:
    """A power of two bits, PROBES of which tell of each hash."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether the table may have these hashes; it never denies one that it has."""
        out = np.ones(len(h), bool)
        low, high = h & np.uint64((1 << 31) - 1), h >> np.uint64(33)
        for i in range(PROBES):
            at = (low + np.uint64(i) * high) & self.mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def bloom(table: DataFrame) -> Filter:
    """The filter of a written table's hashes h. Its size follows their number up to MOST_BITS; beyond, it tells less."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, table.count() * BITS_EACH)))))
    low, high = F.col("h").bitwiseAND((1 << 31) - 1), F.shiftrightunsigned("h", 33)
    at = F.explode(F.array(*((low + high * i).bitwiseAND(bits - 1) for i in range(PROBES))))
    words = table.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()  # MOST_BITS / 64 rows at most, 16 MB
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return Filter(out.view(np.uint64))
