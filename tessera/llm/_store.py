"""Shared tables that cut lineage.

Every multi-step operator writes its intermediate results as Parquet below the
folder named by ``spark.checkpoint.dir``, which the driver and all executors
see.  A lost executor then costs only the tasks it ran.  Where the setting is
missing and Spark runs in one process (tests), a folder of our own is made and
put into the session; on a cluster that is an error, for no executor would see
it.  The tables go when their operator is done with them, at the latest when
the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get(KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{KEY} names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set(KEY, where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


BATCH_KEY, BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
BYTES_KEY, BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession, rows: int = 1024, size: str = "16m") -> None:
    """Let Python see fewer texts and bytes at a time, unless the session says itself how many."""
    for key, default, mine in ((BATCH_KEY, BATCH_DEFAULT, str(rows)), (BYTES_KEY, BYTES_DEFAULT, size)):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, mine)


_OPEN: list[Scratch] = []


@contextmanager
def released() -> Iterator[None]:
    """Deletes the tables of all operators called inside, at the end, when what they gave has been written."""
    before = len(_OPEN)
    try:
        yield
    finally:
        while len(_OPEN) > before:
            _OPEN.pop().close()


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches one after the other; what one of them held goes back to the system before the next comes."""
    pool = pa.default_memory_pool()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()


class Scratch:
    """Tables of one operator call, each in a folder of its own name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._names: dict[int, str] = {}
        self._n = 0
        base = self._path(self.base)
        files = base.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(base)
        files.deleteOnExit(base)
        _OPEN.append(self)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _next(self) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}"

    def cut(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back."""
        path = self._next()
        writer = df.write.mode("error")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def cut_sorted(self, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        """Write ``df`` in buckets of its keys, one sorted file each, and read it back so that merge joins neither shuffle nor sort it.

        ``df`` must be dealt out by its keys already, as aggregates and joins on
        them are; else a bucket gets several files and is sorted when read.
        Spark relies on the files' order only under the legacy setting made
        here, as it has to list the files for that.
        """
        path = self._next()
        name = f"run_{uuid.uuid4().hex}"
        self.spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self._paths[id(out)] = (out, path)
        self._names[id(out)] = name
        return out

    def close(self) -> None:
        """Delete all tables."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        base = self._path(self.base)
        base.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(base, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this scratch space that nothing reads any more."""
        if name := self._names.pop(id(df), None):
            self.spark.sql(f"DROP TABLE {name}")
        path = self._path(self._paths.pop(id(df))[1])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def planned_bytes(df: DataFrame) -> int | None:
    """What the optimizer takes the size of ``df`` to be, from its files' sizes; no rows are read.  None if it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def spread(docs: DataFrame, split_bytes: int = 128 << 20) -> DataFrame:
    """Rows dealt out to all cores, if they lie in fewer files than there are cores and are little data for each of them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = planned_bytes(docs)
    if size is not None and size < cores * split_bytes and len(docs.inputFiles()) < cores:
        return docs.repartition(2 * cores)
    return docs
