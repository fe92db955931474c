"""Trees of digests and heavy hitters against plain comparisons and counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessera.operators import hitters, merkle, prefilter


def test_changed_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    text = F.when(F.col("doc_id") % 37 == 3, F.concat("text", F.lit("!"))).when(F.col("doc_id") % 41 == 5, F.lit(None)).otherwise(F.col("text"))
    new = docs.filter("doc_id % 50 != 7").withColumn("text", text).unionByName(spark.createDataFrame([(10**9, "new", "en"), (None, "null", None)], docs.schema)).repartition(5)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    want = {i: "removed" if i % 50 == 7 else "changed" for i in ids if i % 50 == 7 or i % 37 == 3 or i % 41 == 5} | {10**9: "added", None: "added"}
    for depth in (1, 3):
        assert {r.doc_id: r.change for r in merkle.changed(docs, new, "doc_id", depth=depth).collect()} == want
    before, after = merkle.tree(docs, "doc_id"), merkle.tree(new, "doc_id")
    assert merkle.unequal_leaves(before, after).count() <= len(want)
    assert merkle.changed(docs, docs.repartition(7), "doc_id").count() == 0
    assert merkle.unequal_leaves(before, merkle.tree(docs.limit(0), "doc_id")).count() == before.leaves.count()
    twice = docs.unionByName(docs.filter("doc_id = 1"))  # an even number of equal rows isn't nothing
    thrice = twice.unionByName(docs.filter("doc_id = 1"))
    assert [tuple(r) for r in merkle.changed(docs, twice, "doc_id").collect()] == [(1, "changed")] == [tuple(r) for r in merkle.changed(docs, thrice, "doc_id").collect()]


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_heavy_hitters(spark, width):
    rng = random.Random(width)
    values = [rng.choice("aabbbcd") for _ in range(300)] + [f"v{i}" for i in range(500)] + [None] * 40 + ["e"] * 40
    rng.shuffle(values)
    rows = spark.createDataFrame([(v, 1) for v in values], "x string, count int").repartition(3)
    counts = Counter(values)
    want = sorted(counts.items(), key=lambda p: (-p[1], p[0] is not None, p[0] or ""))
    for n in (1, 5, 6):
        assert sorted(map(tuple, hitters.heavy_hitters(rows, "x", n, width=width).collect()), key=str) == sorted(want[:n], key=str)
    used = []
    assert hitters.heavy_hitters(rows, "x", 9, width=width, used=used).count() == 9 and used[-1] >= 100  # ties of ones need every value
    assert hitters.heavy_hitters(rows.limit(0), "x", 3).count() == 0
    assert hitters.heavy_hitters(rows.filter("x in ('a', 'c')"), "x", 5).count() == 2


@pytest.mark.parametrize("most_bits", [24, 6])
def test_filter_before_an_anti_join(spark, most_bits):
    rows = spark.range(20_000).selectExpr("nullif(id, 3) as k", "id as x").unionByName(spark.range(5).selectExpr("id as k", "-1 as x"))
    known = spark.range(0, 20_000, 10).selectExpr("id as k", "1 as x").unionByName(spark.createDataFrame([(None, 1)], "k bigint, x int"))
    got = prefilter.without_known(rows, known, "k", most_bits)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(known.select("k"), "k", "left_anti").select("k", "x").collect()))
    assert prefilter.without_known(rows, known.limit(0), "k", most_bits).count() == rows.count()
    words, bits = prefilter.bloom(known, "k", most_bits)
    maybe, new = prefilter.split(rows, words, bits, "k")
    assert maybe.count() + new.count() == rows.count()
    if most_bits == 24:  # what is shuffled: the known tenth, and few more
        assert maybe.count() < 0.13 * rows.count()
