"""Mixing sources to target weights.

Sizes are summed per source, targets follow from the weights, and a document
of a source with rate r = target / size is emitted floor(r) times plus once
more with probability r - floor(r), decided by a hash of its id and a seed.
Nothing is collected: the targets are computed by running sums over the table
of sources, which is as small as there are sources.

Cases.  Null text has size 0.  Null sources form one source, last in order.
A source of size 0 has target 0 and rate 0.  Documents with equal ids draw
alike.  A very long text is one document of its size; texts are only counted
and never grouped.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._store import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Water filling in closed form: source i gets min(most * size_i, level * w_i)
    with the level at which these add up to ``share`` of all sizes.  In order of
    most * size / w the first k sources are at their caps; the level of the
    first k whose next source stays below its own cap is the one sought; levels
    only fall after it.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    ordered = Window.orderBy("full", F.col("source").asc_nulls_last())
    before, everything = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    table = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    table = table.withColumn("full", F.col("cap") / F.col("w"))
    table = table.withColumn("rest", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    table = table.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    table = table.withColumn("level_here", F.col("rest") / F.col("rest_w"))
    table = table.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("full"), F.col("level_here"))).over(everything))
    target = F.when(F.col("level").isNull() | (F.col("full") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("w"))
    return table.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the id and the seed: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, rate, copies, taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    targets = scratch.cut(targets.withColumnRenamed("source", "of_source"))  # one row a source
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor("rate") + (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
        .withColumn("rate", rate).withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    )


def emit_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    The rates are those of the sources, so the texts are read once and meet
    only the table of sources.
    """
    sources = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    rates = targets.select(F.col("source").alias("__mx_source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__mx_rate"))
    rates = Scratch(docs.sparkSession, "mix-rates").cut(rates)
    rate = F.col("__mx_rate")
    copies = (F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("int")
    both = docs.join(rates, F.col("source").eqNullSafe(F.col("__mx_source")))
    return both.withColumn("__mx_copies", copies).filter("__mx_copies > 0").withColumn("__mx_copy", F.explode(F.sequence(F.lit(1), F.col("__mx_copies")))).select(*docs.columns)
