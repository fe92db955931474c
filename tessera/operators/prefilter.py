"""Anti-joins behind a Bloom filter.

The known side's keys are hashed into a bitmap of bounded size by bitwise OR on
the executors.  Rows whose key isn't in it are certainly new: they pass without
a shuffle.  Only the others, the known ones and a few by chance, are shuffled
for an exact anti-join, so the result is that of the anti-join.

Cases.  Null keys are never known, as in an anti-join.  Repeated rows stay
repeated.  With an empty known side every row passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.layout import kept

PER_KEY, MOST_BITS, PROBES = 12, 24, 3  # 2**24 bits are 2 MB


def _places(key: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(F.lit(5), key), 21 * p).bitwiseAND(F.lit((1 << bits) - 1)) for p in range(PROBES)]


def bloom(known: DataFrame, key: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """(a table of one row with ``words``, the bits of a place)."""
    n = known.select(key).distinct().count()
    bits = min(most_bits, 21, max(6, math.ceil(math.log2(max(1, n * PER_KEY)))))
    place = known.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    every = known.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "w").join(words, "w", "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")))).alias("x"))
    return kept(row.select(F.transform("x", lambda s: s["b"]).alias("words"))), bits


def _may_hold(key: Column, bits: int) -> Column:
    found = None
    for p in _places(key, bits):
        bit = F.expr("1L").bitwiseAND(F.call_function("shiftrightunsigned", F.get("words", F.shiftright(p, 6)), p.bitwiseAND(F.lit(63)).cast("int"))) == 1
        found = bit if found is None else found & bit
    return found


def without_known(rows: DataFrame, known: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``rows`` whose key ``known`` hasn't."""
    words, bits = bloom(known, key, most_bits)
    maybe, new = split(rows, words, bits, key)
    return new.unionByName(maybe.join(known.select(F.col(key).alias("__known")).distinct(), F.col(key) == F.col("__known"), "left_anti"))


def split(rows: DataFrame, words: DataFrame, bits: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be known, rows that are certainly new)."""
    held = F.coalesce(_may_hold(F.col(key), bits) & F.col(key).isNotNull(), F.lit(False))
    return rows.join(F.broadcast(words), held, "left_semi"), rows.join(F.broadcast(words), held, "left_anti")
