"""The most frequent values by a Space-Saving sketch and an exact second pass.

Each task keeps ``width`` counters over its rows: a value without one takes over
the smallest counter, which it inherits as its possible error.  Sketches are
merged by adding counters; a value that none names occurs at most as often as
the tasks' smallest full counters add up to.  The named values are counted
exactly, and the best ``n`` are proven if the last one occurs more often than that;
if not, the width is doubled.  Shuffled rows are bounded by the sketches, not by
the number of distinct values.

Cases.  Null values are counted as a value.  Ties go to the smaller value, null
first.  With fewer values than ``n`` all are returned.  An empty table gives no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.layout import kept, lookup


class SpaceSaving:
    def __init__(self, width: int):
        self.width = width
        self.counts: dict[object, int] = {}
        self.heap: list[tuple[int, int, object]] = []  # count when pushed; stale ones are pushed again
        self.number = 0

    def add(self, value: object, times: int = 1) -> None:
        if value in self.counts:
            self.counts[value] += times
            return
        least = 0
        if len(self.counts) >= self.width:
            while True:
                least, _, old = heapq.heappop(self.heap)
                if self.counts[old] == least:
                    break
                self._push(old)
            del self.counts[old]
        self.counts[value] = least + times
        self._push(value)

    def _push(self, value: object) -> None:
        self.number += 1
        heapq.heappush(self.heap, (self.counts[value], self.number, value))

    def unseen(self) -> int:
        """How often a value without a counter can have come."""
        return min(self.counts.values()) if len(self.counts) >= self.width else 0


def _sketches(width: int, kind: pa.DataType):
    """(value, unseen): the values of a task's sketch; one more row, with ``unseen`` set, says how often others can have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SpaceSaving(width)
        for batch in batches:
            for pair in batch.column(0).value_counts().to_pylist():
                sketch.add(pair["values"], pair["counts"])
        values = list(sketch.counts)
        yield pa.RecordBatch.from_arrays([pa.array([*values, None], kind), pa.array([None] * len(values) + [sketch.unseen()], pa.int64())], names=["value", "unseen"])

    return run


def heavy_hitters(rows: DataFrame, value: str, n: int, width: int = 1024, used: list[int] | None = None) -> DataFrame:
    """(value, count) of the ``n`` most frequent values, exactly.  ``used`` gets the widths that were tried."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = rows.schema[value]
    asked = rows.select(F.col(value).alias("value"))
    while True:
        if used is not None:
            used.append(width)
        named = kept(asked.mapInArrow(_sketches(width, to_arrow_type(field.dataType)), f"value {field.dataType.simpleString()}, unseen bigint"))
        unseen = named.agg(F.sum("unseen")).first()[0] or 0
        candidates = named.filter("unseen is null").select(F.col("value").alias("named")).distinct()
        counted = asked.join(lookup(candidates), F.col("value").eqNullSafe(F.col("named")), "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        best = kept(counted.orderBy(F.col("count").desc(), F.col("value").asc_nulls_first()).limit(n))
        found = best.agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).first()
        if unseen == 0 or (found.n == n and found.least > unseen):
            return best.withColumnRenamed("value", value)
        width *= 4
