"""State for each key over a stream of lines: repeats are found whatever order the lines come in.

A key's state is the smallest line number so far, and a timer in event time
clears it when the watermark has passed ``keep`` after the key's last line: so
the state holds the keys of that time only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstLine(StatefulProcessor):
    """Emits each line that isn't its key's first one; if an earlier line comes late, the one that was first until then."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("first", "line bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get() if self.state.exists() else None
        first, timer = (held[0], held[1]) if held else (None, None)
        last = timer - self.keep_ms if timer is not None else 0
        for row in rows:
            last = max(last, int(row["at"]))
            if first is None:
                first = row["line"]
                continue
            later, first = max(first, row["line"]), min(first, row["line"])
            if later != first:
                yield Row(key=key[0], line=later)
        wanted = last + self.keep_ms
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.state.update((first, wanted))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def repeated_lines(lines: DataFrame, key: str, line: str, ts: str, late: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """(key, line) of the lines that repeat the key of a smaller line number; lines without a key are left out.

    For a stream; its state store must be RocksDB (``PROVIDER``).  ``late`` is the
    watermark's delay: lines that come later still are judged, if their key's
    state is kept.
    """
    rows = lines.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(line).cast("long").alias("line"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("at"))
    grouped = rows.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithState(FirstLine(keep_ms), "key string, line bigint", "Append", "EventTime")
