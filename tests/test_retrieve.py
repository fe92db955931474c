import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import leakage as L
from tessera.operators import retrieve as R

ITEMS = {"a": "red red apple", "b": "green apple pie", "c": "blue", "d": ""}
QUERIES = {1: "red apple apple", 2: "pie", 3: "", 4: "none"}


def tables(spark):
    items = spark.createDataFrame([(k, v.split()) for k, v in ITEMS.items()], "item string, tokens array<string>")
    return items, spark.createDataFrame([(k, v.split()) for k, v in QUERIES.items()], "query int, tokens array<string>")


def by_hand(query, k1=1.5, b=0.75):
    docs = {k: v.split() for k, v in ITEMS.items()}
    mean, n, out = sum(map(len, docs.values())) / len(docs), len(docs), {}
    for k, d in docs.items():
        tf, s = Counter(d), 0.0
        for t in query.split():
            df = sum(t in x for x in docs.values())
            if tf[t]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(d) / mean))
        out[k] = s
    return out


def test_bm25(spark):
    items, queries = tables(spark)
    got = {(r.query, r.item): r.score for r in R.fill_zero(R.bm25(items, queries), queries, items).collect()}
    for q, text in QUERIES.items():
        for item, s in by_hand(text).items():
            assert got[q, item] == pytest.approx(s)
    ranked = [(r.item, r["rank"]) for r in R.rank(R.fill_zero(R.bm25(items, queries), queries, items), 2).filter("query = 4").orderBy("rank").collect()]
    assert ranked == [("a", 1), ("b", 2)]  # ties by name


def test_dense_is_exact_with_ties_nulls_and_blocks(spark):
    vectors = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(90, None), (91, [1.0]), (92, [None, 1.0])]
    items = spark.createDataFrame(vectors, "item int, vector array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query int, vector array<double>")
    got = {(r.query, r["rank"]): (r.item, r.score) for r in R.dense(items, queries, 4, block=2).collect()}
    for q in range(5):
        want = sorted((-(i % 3 + q), i) for i in range(30))[:4]
        assert [got[q, r] for r in range(1, 5)] == [(i, float(-s)) for s, i in want]
    assert R.dense(items.limit(0), queries, 3).count() == 0
    assert R.dense(items, queries.limit(0), 3).count() == 0


def test_dense_beyond_the_broadcast(spark):
    rng = __import__("random").Random(3)
    made = lambda n: [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(n)]
    items, queries = spark.createDataFrame(made(60), "item int, vector array<double>").repartition(5), spark.createDataFrame(made(17), "query int, vector array<double>")
    small, large = (sorted(map(tuple, R.dense(items, queries, 3, block=b, broadcast_bytes=n).collect())) for b, n in ((100, 16 << 20), (3, 0)))
    assert small == large and len(small) == 51


def test_retrievers(spark):
    """R7, R10 and the protocol: an encoder that is given, and equal scores in the order of the catalog."""
    encode = lambda texts: [[float(t.count("a")), float(t.count("b")), 1.0] for t in texts]
    items = spark.createDataFrame([("x", "a a a", 2), ("y", "b b", 0), ("z", None, 1)], "item string, text string, ordinal int")
    queries = spark.createDataFrame([(1, "aa"), (2, "")], "query int, text string")
    made = {r["item"]: r.vector for r in R.embed(items, "text", encode).collect()}
    assert made["z"] == [0.0, 0.0, 1.0] and sum(v * v for v in made["x"]) == pytest.approx(1.0)
    for retriever in (R.Bm25Retriever(items), R.DenseRetriever(items, encode, 2)):
        assert set(retriever.scores(queries).columns) == {"query", "item", "score"}
    best = R.rank(R.DenseRetriever(items, encode, 2).scores(queries), 1)
    assert {r.query: r["item"] for r in best.collect()} == {1: "x", 2: "z"}
    scores = items.select(F.lit(1).alias("query"), "item", "ordinal", F.lit(0.1 + 0.2).alias("lexical"), F.lit(0.3).alias("semantic"))
    ranked = R.rank(R.hybrid(scores, digits=None), order=[F.col("ordinal")], digits=None)
    assert [r["item"] for r in ranked.orderBy("rank").collect()] == ["y", "z", "x"]


def test_hybrid_and_adaptive(spark):
    s = spark.createDataFrame([(1, "a", 0.0, 0.2), (1, "b", 2.0, 0.4), (1, "c", 1.0, None), (2, "a", 1.0, 1.0)], "query int, item string, lexical double, semantic double")
    got = {(r.query, r.item): r.score for r in R.hybrid(s, 0.7).collect()}
    assert got == {(1, "a"): 0.0, (1, "b"): 1.0, (1, "c"): pytest.approx(0.15), (2, "a"): 0.0}
    kept = R.adaptive_by_gap(R.rank(R.hybrid(s, 0.7)))
    assert {(r.query, r.item) for r in kept.collect()} == {(1, "b"), (1, "c"), (2, "a")}


def test_measures(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2), (3, "x", 1)], "query int, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "y"), (4, "a")], "query int, item string")
    r = R.recall_mrr(ranked, gold, 2).first()
    assert (r.n, r.recall, r.mrr) == (4, 0.5, pytest.approx(1.5 / 4))
    nulls = spark.createDataFrame([(1, "a"), (2, None), (3, "y")], "query int, item string")
    assert R.recall_with_nulls(ranked, nulls, 1).first().recall == pytest.approx(2 / 3)
    names = spark.createDataFrame([(["a", "b"], "c"), (["a", "b"], "a"), (["a"], None)], "n array<string>, g string")
    assert [x.v for x in names.select(R.inject_gold(F.col("n"), F.col("g")).alias("v")).collect()] == [["a", "c"], ["a", "b"], ["a"]]


def test_catalogs_are_checked(spark):
    with pytest.raises(ValueError):
        R.small(spark.range(11), 10)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_overlaps_against_all_pairs(spark):
    rows = [(i, sorted({(i * 7 + j * 3) % 11 for j in range(i % 5)})) for i in range(20)] + [(50, None)]
    refs = [(j, sorted({(j * 5 + k) % 11 for k in range(j % 4)})) for j in range(7)]
    a = spark.createDataFrame(rows, "id int, tokens array<int>")
    b = spark.createDataFrame(refs, "ref int, tokens array<int>")
    sims = {(i, j): round(jaccard(set(x or []), set(y)), 9) for i, x in rows for j, y in refs}
    assert {(r.id, r.ref): r.sim for r in L.similar_pairs(a, b, 0.3).collect()} == {k: s for k, s in sims.items() if s >= 0.3}
    best = {r.ref: (r.id, r.sim) for r in L.best_match_of_refs(a, b).collect()}
    assert best == {j: min(((-sims[i, j], i) for i, _ in rows))[::-1] and (min((-sims[i, j], i) for i, _ in rows)[1], -min((-sims[i, j], i) for i, _ in rows)[0]) for j, _ in refs}
    mine = {r.id: (r.ref, r.sim) for r in L.best_match_of_rows(a, b).collect()}
    assert mine == {i: (min((-sims[i, j], j) for j, _ in refs)[1], -min((-sims[i, j], j) for j, _ in refs)[0]) for i, _ in rows}
    L.BLOCK_ROWS, kept = 2, L.BLOCK_ROWS
    try:
        assert {r.id: (r.ref, r.sim) for r in L.best_match_of_rows(a, b).collect()} == mine
    finally:
        L.BLOCK_ROWS = kept


def test_audit_tests_the_best_reference_only(spark):
    rows = spark.createDataFrame([(1, "goi cho me"), (2, "xyz"), (3, None)], "id int, text string")
    refs = spark.createDataFrame([(10, "goi cho me a"), (11, "mo ban do")], "ref int, text string")
    got = {r.id: (r.ref, r.leaks) for r in L.audit(rows, refs, block=1).collect()}
    assert got[1] == (10, True) and not got[2][1] and not got[3][1]
    pairs = spark.createDataFrame([("abcd", "bcde"), ("abcd", "a")], "l string, r string")
    assert [r.ratio for r in L.sequence_pairs(pairs, F.col("l"), F.col("r"), 0.7).collect()] == [0.75]
