"""A set of 64-bit hashes as a bitmap of bounded size; it may hold more than was put in, never less.

What passes it must be joined exactly afterwards, so its bounded size costs
nothing but rows that the join then drops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_HASH = 16  # bits
LEAST_BITS, MOST_BITS = 10, 27  # of a place; 2**27 bits are 16 MB
PROBES = (0, 19, 37)  # a place's bits are read from here on


def bitmap(hashes: DataFrame, column: str, most_bits: int = MOST_BITS) -> np.ndarray:
    """The bitmap of a column of longs, made by bitwise OR on the executors; the driver gets 2**most_bits / 8 bytes at most."""
    n = hashes.agg(F.count(column)).first()[0]
    bits = min(most_bits, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n * PER_HASH))))))
    place = F.explode(F.array(*[F.shiftrightunsigned(column, p).bitwiseAND(F.lit((1 << bits) - 1)) for p in PROBES]))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = hashes.filter(F.col(column).isNotNull()).select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may have been put in."""
    mask, one, low = np.uint64(64 * len(bits) - 1), np.uint64(1), np.uint64(63)
    found = None
    for probe in PROBES:
        at = np.arange(len(hashes)) if found is None else np.flatnonzero(found)
        place = (hashes[at] >> np.uint64(probe)) & mask
        hit = (bits[place >> np.uint64(6)] >> (place & low)) & one == one
        if found is None:
            found = hit
        else:
            found[at[~hit]] = False
    return found
