"""Queries on retrieval: benchmark items ask for documents, vectors ask for the centres of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import blockmax
from tessera.operators import retrieve as R
from tessera.plans._tables import table, texts

ALPHAS = tuple(i / 10 for i in range(11))
KS = (1, 2, 3, 5)


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = texts(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), tokenize(F.col("text")).alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), tokenize(F.col("text")).alias("tokens"))
    return docs, asked


def bm25_topk(spark, sf_dir):
    docs, asked = _texts(spark, sf_dir)
    return R.rank(R.bm25(docs, asked), 5, digits=4).select("query", "item", "rank", "score")


def bm25_blockmax(spark, sf_dir):
    """The rows of ``bm25_topk`` from block-max postings: blocks that can't hold one of the best five aren't opened."""
    docs, asked = _texts(spark, sf_dir)
    return blockmax.bm25_top(docs, asked, 5, digits=4).select("query", "item", "rank", "score")


def bm25_idf(spark, sf_dir):
    docs, _ = _texts(spark, sf_dir)
    return R.term_frequencies(docs).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_catalog(spark, sf_dir):
    """A small catalog: one text a source; all of them are ranked, those without a common term with 0."""
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("item")).distinct().withColumn("tokens", tokenize(F.col("item")))
    asked = table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query"), tokenize(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    return R.rank(R.fill_zero(R.bm25(names, asked), asked, names), 3).select("query", "item", "rank", "score")


def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = R.dense(rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 6, digits=4)
    return R.rank(found.filter("query != item").drop("rank"), 5, digits=None).select("query", "item", "rank", "score")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, item, semantic, lexical, gold): every vector against the centre of every label.

    The centres are as few as there are labels, so they lie in one row.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centre = rows.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    centre = centre.groupBy(F.col("label").alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centre"))
    both = rows.crossJoin(R.small(centre))
    dot = F.aggregate(F.zip_with("embedding", "centre", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    signs = F.aggregate(F.zip_with("embedding", "centre", lambda a, b: F.when((a > 0) & (b > 0), 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return both.select(F.col("vec_id").alias("query"), "item", F.round(dot, 6).alias("semantic"), signs.cast("double").alias("lexical"), F.col("label").alias("gold"))


def _gold(pairs: DataFrame, null_label: int | None = None) -> DataFrame:
    g = F.when(F.col("gold") == null_label, F.lit(None)).otherwise(F.col("gold")) if null_label is not None else F.col("gold")
    return pairs.filter(F.col("item") == F.col("gold")).select("query", g.cast("int").alias("item"))


def hybrid_topk(spark, sf_dir):
    return R.rank(R.hybrid(_pairs(spark, sf_dir)), 3).select("query", "item", "rank", "score")


def recall_mrr_at_k(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    ranked = R.rank(R.hybrid(pairs))
    out = None
    for k in KS:
        row = R.recall_mrr(ranked, _gold(pairs), k).select(F.lit(k).cast("bigint").alias("k"), "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))
        out = row if out is None else out.unionByName(row)
    return out


def retriever_comparison(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    rankings = {n: R.rank(pairs.withColumn("score", F.col(n))) for n in ("semantic", "lexical")} | {"hybrid": R.rank(R.hybrid(pairs))}
    return R.compare(rankings, _gold(pairs), [1, 3]).select("retriever", F.col("k").cast("bigint").alias("k"), "n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


def recall_null_counts(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return R.recall_with_nulls(R.rank(R.hybrid(pairs)), _gold(pairs, 0), 2).select("n", F.round("recall", 6).alias("recall"))


def alpha_grid(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return R.alpha_grid(pairs, _gold(pairs), ALPHAS, KS).select("alpha", "k", F.round("recall", 6).alias("recall"))


def alpha_best(spark, sf_dir):
    return R.best_alpha(alpha_grid(spark, sf_dir), 2).select("alpha", "recall")


def alpha_intervals(spark, sf_dir):
    """The sweep's recall at 2, read at every hundredth of alpha."""
    pairs = _pairs(spark, sf_dir)
    found = R.alpha_sweep(pairs, _gold(pairs), 2, steps=100)
    each = found.select(F.explode(F.sequence(F.round(F.col("low") * 100).cast("int"), F.round(F.col("high") * 100).cast("int"))).alias("hundredth"), "recall")
    return each.select("hundredth", F.round("recall", 6).alias("recall"))


def adaptive_k_gap(spark, sf_dir):
    return R.adaptive_by_gap(R.rank(R.hybrid(_pairs(spark, sf_dir)))).select("query", "item", "rank", "k")


def adaptive_k_score(spark, sf_dir):
    top = R.rank(R.hybrid(_pairs(spark, sf_dir)), 1).select("query", R.adaptive_by_score(F.col("score") - 0.3).alias("k"))
    return top.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum((5 - F.col("k")) * 120).alias("saved"))


def top3_mean(spark, sf_dir):
    ranked = R.rank(R.hybrid(_pairs(spark, sf_dir)), 3)
    return ranked.groupBy("query").agg(F.round(F.sum(F.round(F.col("score") * 1000000).cast("bigint")) / F.count(F.lit(1)), 3).alias("mean3"))


def score_histogram(spark, sf_dir):
    edges = [0, 5, 10, 20, 40, 80, 160, 320]
    v = table(spark, sf_dir, "events").select(R.histogram(F.col("value"), edges).alias("low"))
    return v.filter("low is not null").groupBy("low").agg(F.count(F.lit(1)).alias("n"))


def gold_injection(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    names = R.rank(R.hybrid(pairs), 3).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"].cast("string")).alias("names"))
    gold = _gold(pairs).select("query", F.col("item").cast("string").alias("gold"))
    return names.join(gold, "query").select("query", F.array_join(R.inject_gold(F.col("names"), F.col("gold")), "|").alias("names"))


def ranking_check(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    a = R.rank(pairs.withColumn("score", F.col("semantic")), 2)
    b = R.rank(R.hybrid(pairs), 2).filter("query % 7 != 0")
    return R.ranking_matches(a, b).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def score_listing(spark, sf_dir):
    """Queries in rising order of their best score, each with the k it would get."""
    from pyspark.sql import Window

    top = R.rank(R.hybrid(_pairs(spark, sf_dir)), 1).withColumn("score", F.round(F.col("score") - 0.3, 6))
    rows = top.withColumn("bucket", F.col("query") % 8).select("query", "bucket", "score", R.adaptive_by_score(F.col("score")).alias("k"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("score", "query")).cast("bigint"))


def passages(spark, sf_dir):
    """R6."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", R.tool_passage(F.col("n_name"), F.lit("vi"), F.lit("en"), F.array(F.lit("a"), F.col("n_regionkey").cast("string"))).alias("passage"))


def prompt_text(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return t.select("n_nationkey", R.prompt(F.array(F.col("n_name")), F.concat(F.lit("find "), F.col("n_name"))).alias("prompt"), R.tool_text(F.col("n_name"), arguments=F.array(F.lit("a"), F.lit("b"))).alias("tool_text"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_blockmax, bm25_idf, bm25_catalog, dense_topk, hybrid_topk, recall_mrr_at_k, retriever_comparison, recall_null_counts, alpha_grid, alpha_best, alpha_intervals, adaptive_k_gap, adaptive_k_score, top3_mean, score_histogram, gold_injection, ranking_check, score_listing, passages, prompt_text)}

_FOLD = "lower(strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D')))"
_TOKENS = "unnest(regexp_extract_all(" + _FOLD + ", '[a-z0-9_@.+/*:-]+'))"


def _bm25(items: str, queries: str) -> str:
    return f"""items AS ({items}), queries AS ({queries}),
 it AS (SELECT item, {_TOKENS.format(c='text')} AS term FROM items), qt AS (SELECT query, {_TOKENS.format(c='text')} AS term FROM queries),
 post AS (SELECT item, term, count(*) AS tf FROM it GROUP BY ALL), size AS (SELECT item, count(*) AS size FROM it GROUP BY item),
 allsize AS (SELECT i.item, coalesce(size, 0) AS size FROM items i LEFT JOIN size USING (item)), n AS (SELECT count(*) AS n, avg(size) AS mean FROM allsize),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term), asked AS (SELECT query, term, count(*) AS qtf FROM qt GROUP BY ALL),
 raw AS (SELECT query, item, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score FROM asked JOIN df USING (term) JOIN post USING (term) JOIN allsize USING (item), n GROUP BY query, item)"""


_P = """flat AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c0 AS (SELECT label, d, round(avg(x), 6) AS x FROM flat GROUP BY ALL),
 cen AS (SELECT label AS item, list(x ORDER BY d) AS centre FROM c0 GROUP BY label),
 pairs AS (SELECT vec_id AS query, item, round(list_inner_product(embedding::DOUBLE[], centre), 6) AS semantic, len(list_filter(list_zip(embedding, centre), lambda z: z[1] > 0 AND z[2] > 0))::DOUBLE AS lexical, label AS gold FROM embeddings, cen),
 mm AS (SELECT *, (semantic - min(semantic) OVER q) / greatest(max(semantic) OVER q - min(semantic) OVER q, 1e-9) AS s, (lexical - min(lexical) OVER q) / greatest(max(lexical) OVER q - min(lexical) OVER q, 1e-9) AS l FROM pairs WINDOW q AS (PARTITION BY query)),
 hy AS (SELECT query, item, gold, semantic, lexical, round(0.7::DOUBLE * s + 0.3::DOUBLE * l, 6) AS score FROM mm),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM hy)"""
_AL = "al AS (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]::DOUBLE[]) AS alpha), ra AS (SELECT query, alpha, item, gold, row_number() OVER (PARTITION BY query, alpha ORDER BY round(alpha * s + (1.0::DOUBLE - alpha) * l, 6) DESC, item) AS rank FROM mm, al), gr AS (SELECT alpha, k, round(count(*) FILTER (rank <= k) / (SELECT count(DISTINCT query) FROM pairs)::DOUBLE, 6) AS recall FROM ra, (VALUES (1::BIGINT), (2), (3), (5)) ks(k) WHERE item = gold GROUP BY ALL)"
_DOCS = "SELECT doc_id AS item, text FROM documents"
_ITEMS = "SELECT item_id AS query, text FROM benchmark"
_CAT = _bm25("SELECT DISTINCT p_type AS item, p_type AS text FROM part", "SELECT p_partkey AS query, p_name || ' ' || p_type AS text FROM part WHERE p_partkey % 20 = 0")

_BM25_TOP = f"WITH {_bm25(_DOCS, _ITEMS)}, r AS (SELECT query, item, round(score, 4) AS score FROM raw), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM r) SELECT query, item, rank, score FROM k WHERE rank <= 5"

ORACLE = {
    "bm25_topk": _BM25_TOP,
    "bm25_blockmax": _BM25_TOP,
    "bm25_idf": f"WITH it AS (SELECT DISTINCT doc_id, {_TOKENS.format(c='text')} AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM it, n GROUP BY term, n",
    "bm25_catalog": f"WITH {_CAT}, g AS (SELECT query, item FROM queries, items), r AS (SELECT query, item, round(coalesce(score, 0), 6) AS score FROM g LEFT JOIN raw USING (query, item)), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM r) SELECT query, item, rank, score FROM k WHERE rank <= 3",
    "dense_topk": "WITH s AS (SELECT a.vec_id AS query, b.vec_id AS item, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id != b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) SELECT query, item, rank, score FROM r WHERE rank <= 5",
    "hybrid_topk": f"WITH {_P} SELECT query, item, rank, score FROM rk WHERE rank <= 3",
    "recall_mrr_at_k": f"WITH {_P} SELECT k, count(*) AS n, round(avg((rank <= k)::INT), 6) AS recall, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM rk, (VALUES (1::BIGINT), (2), (3), (5)) ks(k) WHERE item = gold GROUP BY k",
    "retriever_comparison": f"WITH {_P}, a AS (SELECT 'hybrid' AS retriever, query, item, gold, rank FROM rk UNION ALL SELECT 'semantic', query, item, gold, row_number() OVER (PARTITION BY query ORDER BY round(semantic, 6) DESC, item) FROM pairs UNION ALL SELECT 'lexical', query, item, gold, row_number() OVER (PARTITION BY query ORDER BY lexical DESC, item) FROM pairs) SELECT retriever, k, count(*) AS n, round(avg((rank <= k)::INT), 6) AS recall, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM a, (VALUES (1::BIGINT), (3)) ks(k) WHERE item = gold GROUP BY retriever, k",
    "recall_null_counts": f"WITH {_P} SELECT count(*) AS n, round(avg((gold = 0 OR rank <= 2)::INT), 6) AS recall FROM rk WHERE item = gold",
    "alpha_grid": f"WITH {_P}, {_AL} SELECT alpha, k, recall FROM gr",
    "alpha_best": f"WITH {_P}, {_AL} SELECT alpha, recall FROM gr WHERE k = 2 ORDER BY recall DESC, alpha LIMIT 1",
    "alpha_intervals": f"""WITH {_P}, a AS (SELECT i::INT AS hundredth, i / 100.0::DOUBLE AS alpha FROM range(101) t(i)), g AS (SELECT query, item AS g, l AS gl, s AS gs FROM mm WHERE item = gold),
      x AS (SELECT hundredth, mm.query, mm.item, g, round(alpha * (s - gs) + (1.0::DOUBLE - alpha) * (l - gl), 12) AS lead FROM mm JOIN g ON g.query = mm.query, a),
      r AS (SELECT hundredth, query, count(*) FILTER (item != g AND (lead > 0 OR (lead = 0 AND item < g))) AS ahead FROM x GROUP BY ALL) SELECT hundredth, round(avg((ahead < 2)::INT), 6) AS recall FROM r GROUP BY hundredth""",
    "adaptive_k_gap": f"WITH {_P}, g AS (SELECT a.query, round(a.score - b.score, 9) AS gap FROM rk a JOIN rk b ON a.query = b.query AND a.rank = 1 AND b.rank = 2), k AS (SELECT query, CASE WHEN gap >= 0.25 THEN 2 WHEN gap >= 0.1 THEN 3 ELSE 5 END::BIGINT AS k FROM g) SELECT query, item, rank, k FROM rk JOIN k USING (query) WHERE rank <= k",
    "adaptive_k_score": f"WITH {_P}, k AS (SELECT CASE WHEN score - 0.3::DOUBLE >= 0.7 THEN 1 WHEN score - 0.3::DOUBLE >= 0.4 THEN 2 WHEN score - 0.3::DOUBLE >= 0.2 THEN 3 ELSE 5 END::BIGINT AS k FROM rk WHERE rank = 1) SELECT k, count(*) AS n, sum((5 - k) * 120)::BIGINT AS saved FROM k GROUP BY k",
    "top3_mean": f"WITH {_P} SELECT query, round(sum(round(score * 1000000)::BIGINT)::DOUBLE / count(*), 3) AS mean3 FROM rk WHERE rank <= 3 GROUP BY query",
    "score_histogram": "WITH e AS (SELECT unnest([0, 5, 10, 20, 40, 80, 160]::DOUBLE[]) AS low, unnest([5, 10, 20, 40, 80, 160, 320]::DOUBLE[]) AS high) SELECT low, count(*) AS n FROM events JOIN e ON value >= low AND value < high GROUP BY low",
    "gold_injection": f"WITH {_P}, t AS (SELECT query, any_value(gold)::VARCHAR AS gold, list(item::VARCHAR ORDER BY rank) AS names FROM rk WHERE rank <= 3 GROUP BY query) SELECT query, array_to_string(CASE WHEN list_contains(names, gold) THEN names ELSE list_append(names[1:len(names) - 1], gold) END, '|') AS names FROM t",
    "ranking_check": f"WITH {_P}, s AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY round(semantic, 6) DESC, item) AS rank FROM pairs), x AS (SELECT query, list(item ORDER BY rank) AS x FROM s WHERE rank <= 2 GROUP BY query), y AS (SELECT query, list(item ORDER BY rank) AS y FROM rk WHERE rank <= 2 AND query % 7 != 0 GROUP BY query) SELECT CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'extra' WHEN x = y THEN 'same' ELSE 'different' END AS verdict, count(*) AS n FROM x FULL JOIN y USING (query) GROUP BY 1",
    "score_listing": f"WITH {_P}, t AS (SELECT query, query % 8 AS bucket, round(score - 0.3::DOUBLE, 6) AS score FROM rk WHERE rank = 1) SELECT query, bucket, score, CASE WHEN score >= 0.7 THEN 1 WHEN score >= 0.4 THEN 2 WHEN score >= 0.2 THEN 3 ELSE 5 END::BIGINT AS k, row_number() OVER (PARTITION BY bucket ORDER BY score, query) AS place FROM t",
    "passages": "SELECT n_nationkey, 'passage: ' || replace(n_name, '_', ' ') || '. vi. en. Parameters: a, ' || n_regionkey::VARCHAR || '.' AS passage FROM nation",
    "prompt_text": "SELECT n_nationkey, '{\"tools\":[\"' || n_name || '\"],\"user_query\":\"find ' || n_name || '\"}' AS prompt, replace(n_name, '_', ' ') || ' a b' AS tool_text FROM nation",
}
