"""Physical layout: what is spread, broadcast or kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(rows: DataFrame, split_bytes: int = 128 << 20) -> DataFrame:
    """``rows`` in more partitions, if they lie in fewer files than there are cores and are little data for each of them.

    A stage that computes much for each row then uses all cores; large inputs
    have splits enough and aren't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < cores * split_bytes and len(rows.inputFiles()) < cores:
        return rows.repartition(2 * cores)
    return rows


def evenly(rows: DataFrame, split_bytes: int = 128 << 20) -> DataFrame:
    """``rows`` in two partitions for each core, unless they fill four splits for each.

    For a stage that computes so much for each row that one split more than
    there are cores would take as long as all others: there a shuffle is little.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(2 * cores) if size < 4 * cores * split_bytes else rows


def lookup(table: DataFrame, most: int = 200_000) -> DataFrame:
    """The table with a broadcast hint, if it has at most ``most`` rows; else as it is, for a shuffled join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where Spark runs in one process may it be missing."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-tables-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def kept(table: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again; it goes when the application ends."""
    spark = table.sparkSession
    name = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    table.write.parquet(name)
    return spark.read.schema(table.schema).parquet(name)
