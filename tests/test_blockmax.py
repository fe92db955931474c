"""Block-max postings against scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessera.functions.text import tokenize
from tessera.operators import blockmax as B
from tessera.operators import retrieve as R


@pytest.mark.parametrize(("block", "k"), [(3, 1), (4, 5), (1000, 3), (2, 40)])
def test_against_all_pairs(spark, block, k):
    rng = random.Random(block)
    items = [(i, ["the"] * rng.randrange(4) + [rng.choice("abcdefgh") for _ in range(rng.randrange(30))]) for i in range(90)] + [(200, []), (201, None), (202, ["the"]), (203, ["the"])]
    queries = [(q, ["the"] + [rng.choice("abcdxyz") for _ in range(q)]) for q in range(6)] + [(7, []), (8, ["no"]), (9, ["a", "a", "the"])]
    items = spark.createDataFrame(items, "item int, tokens array<string>")
    queries = spark.createDataFrame(queries, "query int, tokens array<string>")
    whole = items.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    want = sorted((r.query, r["rank"], r.item, r.score) for r in R.rank(R.bm25(whole, queries), k).collect())
    got = B.top(B.build(whole, block=block), queries, k, first=2)
    assert sorted((r.query, r["rank"], r.item, r.score) for r in got.collect()) == want
    assert B.top(B.build(whole.limit(0), block=block), queries, k).count() == 0
    assert B.top(B.build(whole, block=block), queries.limit(0), k).count() == 0


def test_blocks_are_skipped(spark):
    """Benchmark items ask for documents: a part of the blocks that hold a term of a query is opened, and most pairs that share a term aren't scored."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item"), tokenize(F.col("text")).alias("tokens"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query"), tokenize(F.col("text")).alias("tokens"))
    postings = B.build(docs, asked.select(F.explode("tokens").alias("term")), block=16)
    opened = []
    got = B.top(postings, asked, 5, digits=4, opened=opened)
    want = R.rank(R.bm25(docs, asked), 5, digits=4)
    assert sorted(map(tuple, got.select("query", "item", "rank", "score").collect())) == sorted(map(tuple, want.select("query", "item", "rank", "score").collect()))
    terms = B.asked_terms(asked)
    seen = sum(B._scored(o, terms, postings).count() for o in opened)
    assert seen < 0.7 * R.bm25(docs, asked).count(), seen
