"""Queries by digests and sketches, with SQL that needs neither."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import hitters, merkle, prefilter
from tessera.plans._tables import table, texts


def changed_documents(spark, sf_dir):
    """Documents against a version in which some are gone, some new and some altered."""
    old = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    text = F.when(F.col("doc_id") % 211 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    new = old.filter("doc_id % 307 != 5").withColumns({"text": text, "lang": F.when(F.col("doc_id") % 401 == 7, F.lit("xx")).otherwise(F.col("lang"))})
    new = new.unionByName(old.filter("doc_id % 500 = 1").withColumn("doc_id", F.col("doc_id") + 10**9))
    return merkle.changed(old, new, "doc_id").select("doc_id", "change")


def frequent_words(spark, sf_dir):
    """The hundred most frequent words of all documents, by a sketch and an exact second pass."""
    words = texts(spark, sf_dir, "documents").select(F.explode(tokenize(F.col("text"))).alias("word"))
    return hitters.heavy_hitters(words, "word", 100, width=4096).select("word", F.col("count").alias("n"))


def lines_without_order(spark, sf_dir):
    """Lines whose order isn't among the urgent ones, by a filter before the shuffle."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return prefilter.without_known(lines, urgent, "l_orderkey").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


QUERIES = {f.__name__: f for f in (changed_documents, frequent_words, lines_without_order)}

_WORDS = "unnest(regexp_extract_all(lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))), '[a-z0-9_@.+/*:-]+'))"

ORACLE = {
    "changed_documents": """SELECT doc_id, CASE WHEN doc_id % 307 = 5 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 307 = 5 OR (doc_id % 211 = 3 AND text IS NOT NULL) OR (doc_id % 401 = 7 AND lang IS DISTINCT FROM 'xx')
      UNION ALL SELECT doc_id + 1000000000, 'added' FROM documents WHERE doc_id % 500 = 1""",
    "lines_without_order": "SELECT l_linenumber, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 20 = 0) GROUP BY 1",
    "frequent_words": f"WITH w AS (SELECT {_WORDS} AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 100",
}
