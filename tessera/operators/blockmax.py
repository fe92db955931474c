"""BM25's best items by block-max postings.

Items are put into blocks of about ``BLOCK`` of like size, for a term weighs
much in short items and little in long ones.  A posting is a row for (term,
block): the items, their exact term frequencies, and the largest weight that the
term has there.  Postings are written once and serve any queries.

A query's bound of a block is the sum of its terms' largest weights; no item of
the block scores more.  The blocks of largest bound are scored first and give a
floor, the k-th best score so far; then those whose bound reaches the floor,
twice as many a query in every round, until no block is left above the floor.
Blocks below it are never opened.  A term that all items share costs a header a
block, and lists only in the blocks that are opened, which are joined by (term,
block): no join has a hot term as its key.

Cases.  Items without tokens are in no posting but count in n and in the mean
size.  Repeated terms of a query count each time.  Ties, after rounding, go to
the smaller item: a floor is lowered by the rounding before blocks are skipped.
Without items or queries there are no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.layout import kept, lookup
from tessera.operators.retrieve import inverse_frequency, rank, term_counts

BLOCK = 128
GROWTH = 1.25  # sizes within this factor go to blocks together
FIRST = 4  # blocks a query is given in the first round


@dataclass(frozen=True)
class Postings:
    """``headers``: (term, block, top); ``lists``: (term, block, entries of item and weight); both written tables."""

    headers: DataFrame
    lists: DataFrame


def build(items: DataFrame, terms: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, block: int = BLOCK) -> Postings:
    """Postings of (item, tokens); with ``terms`` (term) of these terms only, for queries that are known beforehand."""
    whole = F.concat(term_counts(F.col("tokens")), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf"))))
    each = items.select("item", F.size("tokens").alias("size"), F.explode(whole).alias("t")).select("item", "size", "t.term", "t.tf")
    if terms is not None:
        asked = lookup(terms.select(F.col("term").alias("__asked")).distinct())
        each = each.join(asked, F.col("term") == F.col("__asked"), "left").filter("term is null or __asked is not null").drop("__asked")
    each = kept(each)
    own = each.filter("term is null")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    used = each.filter("term is not null")
    df = lookup(used.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    length = 1 - b + b * F.col("size") / F.nullif(F.col("mean"), F.lit(0.0))
    weight = inverse_frequency(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    # Sizes fall into some hundred classes at most, for a size is an int; each has as many blocks as its items need.
    about = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(GROWTH))).cast("int")
    blocks = own.filter("size > 0").groupBy(about.alias("class")).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    place = F.concat_ws("/", "class", F.pmod(F.xxhash64("item"), F.col("blocks"))).alias("block")
    weighed = used.withColumn("class", about).join(F.broadcast(blocks), "class").join(df, "term").crossJoin(F.broadcast(size)).select("term", place, "item", weight.alias("w"))
    lists = kept(weighed.groupBy("term", "block").agg(F.max("w").alias("top"), F.collect_list(F.struct("item", "w")).alias("entries")))
    return Postings(lists.select("term", "block", "top"), lists.select("term", "block", "entries"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query, term, qtf) of (query, tokens), a written table."""
    return kept(queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _scored(chosen: DataFrame, asked: DataFrame, postings: Postings) -> DataFrame:
    """(query, item, score) of all items of (query, block) that share a term with the query."""
    wanted = chosen.join(asked, "query").select("query", "block", "term", "qtf")
    found = wanted.join(postings.lists, ["term", "block"]).select("query", "qtf", F.explode("entries").alias("e"))
    return found.groupBy("query", "e.item").agg(F.sum(F.col("qtf") * F.col("e.w")).alias("score"))


def top(postings: Postings, queries: DataFrame, k: int, digits: int = 6, first: int = FIRST, opened: list[DataFrame] | None = None) -> DataFrame:
    """(query, item, score, rank): each query's k best items.  ``opened`` gets the (query, block) that were scored in each round."""
    asked = asked_terms(queries)
    headers = postings.headers.join(lookup(asked), "term")
    bounds = headers.groupBy("query", "block").agg(F.sum(F.col("qtf") * F.col("top")).alias("bound"))
    left = kept(bounds.withColumn("place", F.row_number().over(_by_bound())))
    slack = 10.0**-digits
    done, best, last = 0, None, first
    while True:
        now = left.filter((F.col("place") > done) & (F.col("place") <= last))
        if best is not None:
            floor = best.filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
            alive = lambda rows: rows.join(lookup(floor), "query", "left").filter(F.col("floor").isNull() | (F.col("bound") + slack >= F.col("floor")))  # noqa: B023, E731
            now = alive(now)
        now = kept(now.select("query", "block"))
        if opened is not None:
            opened.append(now)
        if best is not None and now.isEmpty():
            # Bounds fall with the place, so what comes later is below the floor, too.
            return best
        scored = _scored(now, asked, postings)
        best = kept(rank(scored if best is None else scored.unionByName(best.drop("rank")), k, digits=digits))
        done, last = last, 3 * last


def _by_bound():
    from pyspark.sql import Window

    return Window.partitionBy("query").orderBy(F.col("bound").desc(), "block")


def bm25_top(items: DataFrame, queries: DataFrame, k: int, digits: int = 6, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best of (item, tokens) for each of (query, tokens): postings of the queries' terms, then ``top``."""
    terms = queries.select(F.explode("tokens").alias("term"))
    return top(build(items, terms, k1, b), queries, k, digits)
