"""Append and resume, on Structured Streaming and plain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.streaming.versions import VersionedTable


def pending(examples: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The examples that aren't completed; an empty result means that nothing is left."""
    return examples.join(done.select(key).distinct(), key, "left_anti")


def resume_faults(examples: DataFrame, done: DataFrame, key: str = "id", protocol: str | None = "protocol_id") -> DataFrame:
    """(fault, key): completed ids that repeat or are unknown, and a second protocol."""
    repeated = done.groupBy(key).count().filter("count > 1").select(F.lit("repeated").alias("fault"), F.col(key).cast("string").alias("key"))
    unknown = done.join(examples.select(key), key, "left_anti").select(F.lit("unknown").alias("fault"), F.col(key).cast("string").alias("key")).distinct()
    out = repeated.unionByName(unknown)
    if protocol and protocol in done.columns:
        kinds = done.select(F.col(protocol).cast("string").alias("key")).distinct()
        first = kinds.agg(F.min("key").alias("first"))
        mixed = kinds.crossJoin(F.broadcast(first)).filter("key is distinct from first").select(F.lit("mixed protocol").alias("fault"), "key")
        out = out.unionByName(mixed)
    return out


def append_predictions(spark: SparkSession, source: str, schema: str, predict: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id", result: str | None = None, protocol: str = ""):
    """Predict what lies in ``source`` and isn't done yet, once; called again it goes on from the checkpoint.

    Files that come later are predicted by a later call; an id is predicted once.
    Each batch becomes a version of ``out``, named by the batch, so that a batch
    that fails or is repeated leaves nothing behind.  Ids that are done are found
    by an anti-join with the versions, so the stream keeps no state at all.
    ``result`` is the schema of the predictions, by default what ``predict`` gives.
    """
    asked = spark.createDataFrame([], schema)
    table = VersionedTable(spark, out, result or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in predict(asked).schema))

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates([key]).join(table.read().select(key), key, "left_anti")
        table.commit(predict(new.select(*batch.columns)), f"batch-{number:09d}", protocol)

    query = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_appended(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The predictions of whole batches."""
    return VersionedTable(spark, out, schema).read()
