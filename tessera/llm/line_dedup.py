"""Line dedup with levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, top_doc) in buckets of the 128-bit line hash,
each sorted by it: how many documents hold the line and the largest of their
ids.  ``LineRuns.add`` merge-anti-joins the lines of a new batch with the runs
one after another; joins read the runs in their order, without shuffling or
sorting them.  What the anti-joins leave is new and becomes a run of level 0;
lines that a run has go to a table of updates.  So a line is in one run only,
and when ``fanout`` runs of a level are compacted into one of the next, no two
rows meet.  Totals are the runs' counts and those of the updates.  Counts and
maxima combine before every shuffle, so no step holds the lines of one key
together.

Cases.  Null or empty text is one empty line.  Repeated rows with one doc_id
count as one document, and each of them keeps or loses a line alike.  Null
doc_id counts as one document smaller than all others.  Columns of the input
are kept, apart from ``n_lines`` and ``n_dropped``, which are replaced.  A very
long text is split whole, its lines are rows of their own and never meet in one
group.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import Scratch, bound_batches, lean, planned_bytes, spread

STRIPPED = b" \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
_SAME = "__td_"


def _line_keys(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in lean(batches):
            ids, row_keys = batch.column(0), batch.column(1)
            owner: list[int] = []
            index: list[int] = []
            digests: list[bytes] = []
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                for i, line in enumerate(text.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line.strip(STRIPPED).lower()
                    if len(key) < min_chars or not (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        continue
                    owner.append(row)
                    index.append(i)
                    digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), row_keys.take(rows), pa.array(index, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())],
                names=["doc_id", "row_key", "line", "h1", "h2"],
            )

    return keys


class LineRuns:
    """Levelled sorted runs of line hashes."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(spark, "line-runs")
        self.levels: list[list[DataFrame]] = []
        self.updates: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, keyed: DataFrame) -> DataFrame:
        """The rows of ``keyed`` whose line no run has."""
        for run in self.runs():
            keyed = keyed.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keyed

    def add(self, keyed: DataFrame) -> None:
        """``keyed``: (doc_id, h1, h2) of a batch; a document belongs to one batch."""
        self._compact()
        batch = self._sorted(keyed.select("doc_id", *KEY).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc")))
        new = batch
        if self.runs():
            new = self._sorted(self.unseen(batch))
            self.updates.append(self.scratch.cut(batch.join(new.select(*KEY).hint("merge"), KEY, "left_anti")))
            self.scratch.drop(batch)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(new)

    def _sorted(self, run: DataFrame) -> DataFrame:
        return self.scratch.cut_sorted(run.select(*KEY, "n_docs", "top_doc"), KEY, self.buckets)

    def _compact(self) -> None:
        """``fanout`` runs of a level become one of the next."""
        for level, old in enumerate(self.levels):
            if len(old) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._sorted(_merged(old)))
                self.levels[level] = []
                for table in old:
                    self.scratch.drop(table)

    def totals(self) -> DataFrame:
        """One row for each line: n_docs, top_doc."""
        return _merged([*self.runs(), *self.updates])


def _merged(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 4, broadcast_bytes: int = 32 << 20, batch_bytes: int = 64 << 30) -> DataFrame:
    """Drop long lines that many documents repeat, except in the largest doc_id.

    ``text`` is rewritten; ``n_lines`` (before) and ``n_dropped`` are added.
    The line numbers to drop are joined back by document.  They are broadcast
    if their measured size is at most ``broadcast_bytes``, else both sides are
    shuffled.  ``batches``: by default 4 to 64, as many as the planned size of
    ``docs`` has ``batch_bytes``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = spread(docs.drop("n_lines", "n_dropped"))
    batches = batches or min(64, max(4, (planned_bytes(docs) or 0) // batch_bytes))
    row_key = F.xxhash64("text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, line int, h1 bigint, h2 bigint"
    scratch = Scratch(spark, "line-keys")
    keyed = docs.select("doc_id", row_key.alias("row_key"), "text").mapInArrow(_line_keys(min_chars), schema)
    keyed = scratch.cut(keyed.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), partition_by="batch")
    runs = LineRuns(spark, fanout)
    for b in range(batches):
        runs.add(keyed.filter(F.col("batch") == b))
    # A table, so that the join broadcasts it, or shuffles both sides and a very common line can be split.
    frequent = scratch.cut(runs.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, "top_doc"))
    lost = keyed.join(frequent, KEY).filter(~F.col("doc_id").eqNullSafe(F.col("top_doc"))).groupBy("doc_id", "row_key").agg(F.collect_set("line").alias("lines"))
    lost = scratch.cut(lost)
    weight = lost.agg(F.coalesce(F.sum(F.size("lines") * 8 + 64), F.lit(0))).first()[0]
    lost = lost.select(F.col("doc_id").alias(f"{_SAME}id"), F.col("row_key").alias(f"{_SAME}row"), F.col("lines").alias(f"{_SAME}lines"))
    if weight <= broadcast_bytes:
        lost = F.broadcast(lost)
    both = docs.join(lost, F.col("doc_id").eqNullSafe(F.col(f"{_SAME}id")) & (row_key == F.col(f"{_SAME}row")), "left")
    text, gone = F.coalesce(F.col("text"), F.lit("")), F.col(f"{_SAME}lines")
    # Bound to a variable of a lambda, the lines are split off once for each text.
    without = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")
    kept = F.transform(F.array(F.split(text, "\n", -1)), without)[0]
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return both.select(
        *[F.when(gone.isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )
