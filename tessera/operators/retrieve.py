"""Retrieval and ranking.

Scores are long tables (query, item, score).  A retriever is anything that
returns such a table; ``rank`` and the measures work on all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import tiles
from tessera.operators.layout import kept, lookup
from tessera.operators.validate import small

RANGE_FLOOR = 1e-9


class Retriever(Protocol):
    def scores(self, queries: DataFrame) -> DataFrame:
        """(query, ...) to (query, item, score)."""


def tool_text(name: Column, *descriptions: Column, arguments: Column) -> Column:
    """What a tool is found by."""
    return F.concat_ws(" ", F.replace(name, F.lit("_"), F.lit(" ")), *descriptions, F.array_join(arguments, " "))


def tool_passage(name: Column, vi: Column, en: Column, arguments: Column) -> Column:
    """What a tool is embedded by."""
    return F.format_string("passage: %s. %s. %s. Parameters: %s.", F.replace(name, F.lit("_"), F.lit(" ")), vi, en, F.array_join(arguments, ", "))


def inverse_frequency(n: Column, df: Column) -> Column:
    """R3."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_counts(tokens: Column) -> Column:
    """R2: array of (term, tf), counted in the row: the sorted tokens' runs."""

    def of_sorted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = lambda at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
        # Bound to a variable of a lambda, the places are found once.
        return F.transform(F.array(starts), lambda at: F.zip_with(at, ends(at), lambda i, j: F.struct(F.get(s, i).alias("term"), (j - i).cast("bigint").alias("tf"))))[0]

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, F.transform(F.array(F.array_sort(tokens)), of_sorted)[0]).otherwise(none)


def postings(items: DataFrame, tokens: str = "tokens") -> DataFrame:
    """R2: (item, term, tf, size); an item is one row, so nothing is shuffled."""
    return items.select("item", F.size(tokens).alias("size"), F.explode(term_counts(F.col(tokens))).alias("t")).select("item", F.col("t.term").alias("term"), F.col("t.tf").alias("tf"), "size")


def bm25(items: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(item, tokens) and (query, tokens) to (query, item, score) of pairs that share a term.

    Repeated query terms count each time.  Items are read once: their counts of
    the queries' terms, and a row with their size, go to a checkpoint.  The
    queries' terms are broadcast while they are few, so that an item's postings
    stay together and scores are summed up before they are shuffled.  Pairs
    without a common term have score 0 and are left out.
    """
    asked = queries.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = kept(asked)
    terms = lookup(asked.select("term").distinct())
    whole = F.concat(term_counts(F.col("tokens")), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf"))))
    each = items.select("item", F.size("tokens").alias("size"), F.explode(whole).alias("t")).select("item", "size", "t.term", "t.tf")
    used = kept(each.join(terms.withColumnRenamed("term", "__asked"), F.col("term") == F.col("__asked"), "left").filter("term is null or __asked is not null").drop("__asked"))
    size = used.filter("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean"))
    used = used.filter("term is not null")
    df = lookup(used.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    length = 1 - b + b * F.col("size") / F.nullif(F.col("mean"), F.lit(0.0))
    weight = inverse_frequency(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    weighed = used.join(df, "term").crossJoin(F.broadcast(size)).select("item", "term", weight.alias("w"))
    return weighed.join(lookup(asked), "term").groupBy("query", "item").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def term_frequencies(items: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = items.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("n")))).select("term", "df", inverse_frequency(F.col("n"), F.col("df")).alias("idf"))


def fill_zero(scores: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """All items of a small catalog for each query, 0 where nothing matched."""
    grid = queries.select("query").crossJoin(small(items.select("item")))
    return grid.join(scores, ["query", "item"], "left").fillna(0.0, ["score"])


def rank(scores: DataFrame, k: int | None = None, order: Sequence[Column] = (), digits: int | None = 6) -> DataFrame:
    """Adds ``rank`` by falling score, ties by item; scores are rounded first, so ties are the same anywhere."""
    s = scores.withColumn("score", F.round("score", digits)) if digits is not None else scores
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), *(order or [F.col("item").asc()]))
    s = s.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return s if k is None else s.filter(F.col("rank") <= k)


class _DenseTile:
    """A tile's queries against packs of items: for each the k best."""

    def __init__(self, queries: pa.Table, k: int, digits: int):
        import numpy as np

        self.np, self.k, self.digits = np, k, digits
        self.queries, self.by_size = queries, {}
        for q, v in enumerate(queries.column("vector").to_pylist()):
            if v is not None and None not in v:
                self.by_size.setdefault(len(v), []).append((q, v))
        self.by_size = {n: ([q for q, _ in mine], np.array([v for _, v in mine], float)) for n, mine in self.by_size.items()}
        self.best: list[list] = [[] for _ in range(queries.num_rows)]
        self.item_type = None

    def offer(self, pack: pa.Table) -> None:
        np, self.item_type = self.np, pack.schema.field("item").type
        items, vectors = pack.column("item").to_pylist(), pack.column("vector").to_pylist()
        for size, (numbers, matrix) in self.by_size.items():
            sound = [i for i, v in enumerate(vectors) if v is not None and len(v) == size and None not in v]
            if not sound:
                continue
            scores = np.round(matrix @ np.array([vectors[i] for i in sound], float).T, self.digits)
            few = min(self.k, len(sound))
            for row, q in enumerate(numbers):
                least = np.partition(scores[row], len(sound) - few)[len(sound) - few]
                near = np.flatnonzero(scores[row] >= least)
                self.best[q] = sorted(self.best[q] + [(-scores[row][i], items[sound[i]]) for i in near])[: self.k]

    def found(self) -> pa.RecordBatch:
        asked = self.queries.column("query").to_pylist()
        rows = [(asked[q], item, -s) for q, mine in enumerate(self.best) for s, item in mine]
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = self.queries.schema.field("query").type, self.item_type or pa.int64(), pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query", "item", "score"])


def dense(items: DataFrame, queries: DataFrame, k: int, block: int = 2048, digits: int = 6, broadcast_bytes: int = tiles.BROADCAST_BYTES) -> DataFrame:
    """(item, vector) and (query, vector) to the k best items of each query, by inner product.

    Queries lie in tiles of about ``block`` rows that the executors make; each
    task multiplies packs of items with a tile and keeps k a query.  Vectors
    that are null, hold a null or are of another length take no part.
    """
    some = queries.select("query", "vector").filter("vector is not null")
    count = max(1, -(-some.count() // block))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, score double"
    found = tiles.met(tiles.tiled(some, count), count, items.select("item", "vector"), lambda _, t: _DenseTile(t, k, digits), schema, broadcast_bytes)
    return rank(found, k, digits=digits)


def embed(rows: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Adds ``vector``, of unit length, as ``encode`` gives it for batches of texts on the executors; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            made = np.array(encode([t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]), float).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(made, axis=1, keepdims=True)
            yield batch.append_column("vector", pa.array((made / np.where(norm > 0, norm, 1.0)).tolist(), pa.list_(pa.float64())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, vector array<double>")


@dataclass(frozen=True)
class Bm25Retriever:
    """R2 as a retriever over (item, text)."""

    items: DataFrame
    k1: float = 1.5
    b: float = 0.75

    def scores(self, queries: DataFrame) -> DataFrame:
        from tessera.functions.text import tokenize

        return bm25(self.items.select("item", tokenize(F.col("text")).alias("tokens")), queries.select("query", tokenize(F.col("text")).alias("tokens")), self.k1, self.b)


@dataclass(frozen=True)
class DenseRetriever:
    """R7, R8 as a retriever over (item, text), of the k best items of a query."""

    items: DataFrame
    encode: Callable[[list[str]], list[list[float]]]
    k: int

    def scores(self, queries: DataFrame) -> DataFrame:
        return dense(embed(self.items, "text", self.encode), embed(queries.select("query", "text"), "text", self.encode), self.k).drop("rank")


def min_max(scores: DataFrame, column: str) -> Column:
    """The column scaled to its range within the query."""
    w = Window.partitionBy("query")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return (F.coalesce(F.col(column), low) - low) / F.greatest(high - low, F.lit(RANGE_FLOOR))


def hybrid(scores: DataFrame, alpha: float | Column = 0.7, lexical: str = "lexical", semantic: str = "semantic", digits: int | None = 6) -> DataFrame:
    """(query, item, lexical, semantic) to (query, item, score).

    Each score is scaled within its query; a missing semantic score counts as
    the least.  Rounding comes before any ranking.
    """
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    scaled = scores.withColumns({"__l": min_max(scores, lexical), "__s": min_max(scores, semantic)})
    score = a * F.col("__s") + (1.0 - a) * F.col("__l")
    return scaled.withColumn("score", score if digits is None else F.round(score, digits)).drop("__l", "__s")


def adaptive_by_gap(ranked: DataFrame, max_k: int = 5, k_min: int = 2, steps: Sequence[tuple[float, int]] = ((0.25, 2), (0.10, 3))) -> DataFrame:
    """Keep as many as the gap between the first two allows: adds ``k``; one item has gap 1."""
    per = ranked.filter("rank <= 2").groupBy("query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    gap = F.round(F.when(F.col("b").isNull(), 1.0).otherwise(F.col("a") - F.col("b")), 9)
    k = None
    for least, value in steps:
        k = F.when(gap >= least, value) if k is None else k.when(gap >= least, value)
    per = per.select("query", F.greatest(k.otherwise(max_k), F.lit(k_min)).cast("bigint").alias("k"))
    return ranked.join(per, "query").filter(F.col("rank") <= F.least("k", F.lit(max_k)))


def adaptive_by_score(score: Column, steps: Sequence[tuple[float, int]] = ((0.7, 1), (0.4, 2), (0.2, 3)), otherwise: int = 5) -> Column:
    """R12."""
    k = None
    for least, value in steps:
        k = F.when(score >= least, value) if k is None else k.when(score >= least, value)
    return k.otherwise(otherwise).cast("bigint")


def histogram(value: Column, edges: Sequence[float]) -> Column:
    """The lower edge of the half-open bin; null below the first and from the last edge on."""
    out = None
    for low, high in zip(edges, edges[1:]):
        inside = (value >= low) & (value < high)
        out = F.when(inside, F.lit(float(low))) if out is None else out.when(inside, F.lit(float(low)))
    return out


def recall_mrr(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Over the queries of ``gold`` (query, item): n, recall and mean reciprocal rank at k."""
    hit = ranked.filter(F.col("rank") <= k).join(gold.select("query", F.col("item").alias("__gold")), "query").filter(F.col("item") == F.col("__gold")).groupBy("query").agg(F.min("rank").alias("rank"))
    return gold.select("query").distinct().join(hit, "query", "left").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def recall_with_nulls(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Queries without a gold item count as hits and stay in the denominator."""
    hit = ranked.filter(F.col("rank") <= k).select("query", "item", F.lit(True).alias("hit"))
    rows = gold.join(hit, ["query", "item"], "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("item").isNull() | F.coalesce("hit", F.lit(False))).cast("int")).alias("recall"))


def alpha_grid(scores: DataFrame, gold: DataFrame, alphas: Sequence[float], ks: Sequence[int]) -> DataFrame:
    """Recall of every alpha and k.

    The gold item's rank at an alpha is one more than the number of rivals that
    stand before it there, so each pair of a rival and the gold item is looked at
    once and counted for all alphas together; nothing is ranked.
    """
    scaled = scores.select("query", "item", min_max(scores, "lexical").alias("l"), min_max(scores, "semantic").alias("s"))
    pairs = scaled.join(scaled.join(gold, ["query", "item"]).select("query", F.col("item").alias("g"), F.col("l").alias("gl"), F.col("s").alias("gs")), "query")

    def before(a: float) -> Column:
        score = lambda s, l: F.round(F.lit(a) * F.col(s) + (F.lit(1.0) - F.lit(a)) * F.col(l), 6)  # noqa: E741, E731
        return (score("s", "l") > score("gs", "gl")) | ((score("s", "l") == score("gs", "gl")) & (F.col("item") < F.col("g")))

    ranks = pairs.groupBy("query", "g").agg(*[F.count_if(before(float(a))).alias(f"r{i}") for i, a in enumerate(alphas)])
    each = ranks.select(F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), (F.col(f"r{i}") + 1).alias("rank")) for i, a in enumerate(alphas)])).alias("x")).select("x.alpha", "x.rank")
    n = gold.select("query").distinct().agg(F.count(F.lit(1)).alias("n"))
    counted = each.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).groupBy("alpha", "k").agg(F.sum((F.col("rank") <= F.col("k")).cast("bigint")).alias("hits"))
    return counted.crossJoin(F.broadcast(n)).select("alpha", F.col("k").cast("bigint").alias("k"), (F.col("hits") / F.col("n")).alias("recall"))


def alpha_sweep(scores: DataFrame, gold: DataFrame, k: int, steps: int = 1_000_000) -> DataFrame:
    """(low, high, recall): the recall at k for every alpha that is a multiple of 1 / ``steps``, as intervals.

    A rival's lead over the gold item is linear in alpha, so it changes sides once
    at most, at a crossing.  A query's crossings in order say where its gold item
    enters or leaves the first k; these steps of all queries, summed by alpha, are
    at most ``steps`` + 1 rows, and their running sum is the recall everywhere.
    """
    scaled = scores.select("query", "item", min_max(scores, "lexical").alias("l"), min_max(scores, "semantic").alias("s"))
    pairs = scaled.join(scaled.join(gold, ["query", "item"]).select("query", F.col("item").alias("g"), F.col("l").alias("gl"), F.col("s").alias("gs")), "query").filter("item != g")
    lead = lambda i: F.round(i / F.lit(float(steps)) * (F.col("s") - F.col("gs")) + (F.lit(1.0) - i / F.lit(float(steps))) * (F.col("l") - F.col("gl")), 12)
    ahead = lambda i: (lead(i) > 0) | ((lead(i) == 0) & (F.col("item") < F.col("g")))
    first, last = F.lit(0), F.lit(steps)
    from_l, from_s = F.col("gl") - F.col("l"), F.col("s") - F.col("gs")
    guess = F.floor(from_l / F.nullif(from_l + from_s, F.lit(0.0)) * steps)
    # The crossing lies between the steps beside the computed one, whatever the rounding.
    near = F.array(*[F.least(F.greatest(guess + d, F.lit(1).cast("bigint")), F.lit(steps).cast("bigint")) for d in (-1, 0, 1, 2)])
    pairs = pairs.withColumns({"at_first": ahead(first), "at_last": ahead(last), "near": near})
    turn = F.array_min(F.filter("near", lambda i: ahead(i) == F.col("at_last")))
    events = F.when(F.col("at_first"), F.array(F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(1).alias("d")))).otherwise(F.array().cast("array<struct<at:bigint,d:int>>"))
    events = F.concat(events, F.when(F.col("at_first") != F.col("at_last"), F.array(F.struct(turn.alias("at"), F.when(F.col("at_last"), 1).otherwise(-1).alias("d")))).otherwise(F.array().cast("array<struct<at:bigint,d:int>>")))
    moved = pairs.select("query", F.explode(events).alias("e")).groupBy("query", "e.at").agg(F.sum("e.d").alias("d"))
    begun = gold.select("query").distinct().join(scaled.join(gold, ["query", "item"]).select("query").distinct(), "query").select("query", F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("d"))
    moved = moved.unionByName(begun).groupBy("query", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("query").orderBy("at")
    inside = moved.withColumn("in", (F.sum("d").over(w) < k).cast("int")).withColumn("step", F.col("in") - F.coalesce(F.lag("in").over(w), F.lit(0)))
    steps_at = inside.filter("step != 0").groupBy("at").agg(F.sum("step").alias("step")).filter("step != 0 or at = 0")
    n = gold.select("query").distinct().agg(F.count(F.lit(1)).alias("n"))
    along = Window.orderBy("at")  # of ``steps`` + 1 rows at most
    out = steps_at.crossJoin(F.broadcast(n)).select("at", (F.sum("step").over(along) / F.col("n")).alias("recall"), F.lead("at").over(along).alias("next"))
    return out.select((F.col("at") / steps).alias("low"), ((F.coalesce("next", F.lit(steps + 1)) - 1) / steps).alias("high"), "recall")


def best_alpha(grid: DataFrame, k: int = 2) -> DataFrame:
    """The smallest alpha of the highest recall at k."""
    return grid.filter(F.col("k") == k).orderBy(F.col("recall").desc(), "alpha").limit(1)


def compare(rankings: dict[str, DataFrame], gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Recall and MRR of each retriever at each k."""
    out = None
    for name, ranked in rankings.items():
        for k in ks:
            row = recall_mrr(ranked, gold, k).select(F.lit(name).alias("retriever"), F.lit(k).alias("k"), "n", "recall", "mrr")
            out = row if out is None else out.unionByName(row)
    return out


def inject_gold(names: Column, gold: Column) -> Column:
    """The gold name takes the last place if it isn't among the names."""
    return F.when(gold.isNull() | F.array_contains(names, gold), names).otherwise(F.concat(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.array(gold)))


def ranking_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query, verdict) of two rankings: same, different, missing or extra."""
    pack = lambda r, n: r.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias(n))
    both = pack(a, "x").join(pack(b, "y"), "query", "full_outer")
    return both.select("query", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") == F.col("y"), "same").otherwise("different").alias("verdict"))


def prompt(tools: Column, query: Column) -> Column:
    """R19."""
    return F.to_json(F.struct(tools.alias("tools"), query.alias("user_query")))
