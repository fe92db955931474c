"""The metric index against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tessera.operators import sequences as S


def ratio(x, y):
    return SequenceMatcher(None, x, y).ratio()


def made(seed, n, longest):
    rng = random.Random(seed)
    words = ["mở", "cài", "đặt", "gọi", "cho", "Lan", "8", "giờ", "sáng", "tin", "nhắn", "the", "a"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            t = list(rng.choice(texts))
            for _ in range(rng.randrange(1 + len(t) // 8)):
                k = rng.randrange(len(t) + 1)
                t[k : k + rng.randrange(2)] = rng.choice(["", "x", "é", " "])
            texts.append("".join(t))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(longest))))
    return texts


@pytest.mark.parametrize(("seed", "longest", "least"), [(1, 4, 0.9), (2, 12, 0.8), (3, 90, 0.9), (4, 6, 0.5)])
def test_against_all_pairs(spark, seed, longest, least):
    texts = made(seed, 90, longest) + ["", "", "a", "aaaa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None)], "id bigint, text string")
    want = {}
    for i, t in enumerate(texts):
        others = [(-ratio(t, u), j) for j, u in enumerate(texts) if j != i and ratio(t, u) >= least]
        if others:
            want[i] = (min(others)[1], -min(others)[0])
    got = {r.id: (r.peer, r.ratio) for r in S.nearest_by_sequence(rows, least).collect()}
    assert got == want
    refs = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(made(seed + 9, 30, longest) + texts[::7] + [""])], "ref string, text string")
    pairs = {(r.ref, q.id): ratio(r.text, q.text) for r in refs.collect() for q in rows.collect() if q.text is not None and ratio(r.text, q.text) >= least}
    assert {(r.ref, r.id): r.ratio for r in S.matches_between(rows, refs, least).collect()} == pairs


def test_bounds_hold():
    rng = random.Random(6)
    for _ in range(3000):
        x = "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 40)))
        y = list(x)
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(3)] = rng.choice("abxyz")
        y = "".join(y)
        assert S.may_reach(S.counts(x), S.counts(y), ratio(x, y)), (x, y)


def test_few_pairs_are_computed(spark):
    """A corpus against itself: of all pairs few leave the index, and next to none are computed."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    texts = S.classes(turns.select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text"))
    of = {r.key: S.counts(r.text) for r in texts.collect()}
    index = S._indexed(texts, S._pivots(texts, 3))
    left = S.candidates(index, index, 0.9, itself=True).collect()
    pairs = len(of) * (len(of) - 1) / 2
    assert len(left) < 0.08 * pairs
    computed = sum(bool(S.may_reach(of[r.a], of[r.b], 0.9)) for r in left)
    assert computed < 0.04 * pairs, (pairs, len(left), computed)


def test_peers_of_turns(spark):
    """The query against all pairs."""
    from tessera.functions.text import normalize
    from tessera.plans import leaks

    turns = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", normalize(F.col("text"), "leak").alias("t"), normalize(F.concat(F.lit("ok "), "text"), "leak").alias("p")).collect()
    texts = {f"{r.conv_id}/{r.turn}": r.t for r in turns} | {f"planted/{r.conv_id}/{r.turn}": r.p for r in turns if r.conv_id % 5 == 0}
    want = {}
    for i, t in texts.items():
        near = [(-ratio(t, u), j) for j, u in texts.items() if j != i and min(len(t), len(u)) * 2 >= 0.9 * (len(t) + len(u)) and ratio(t, u) >= 0.9]
        if near:
            want[i] = (min(near)[1], round(-min(near)[0], 6))
    got = {r.id: (r.peer, r.ratio) for r in leaks.leak_seq_peers(spark, DATA).collect()}
    assert got == want and any(i.startswith("planted") for i in got)


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    assert S.nearest_by_sequence(none, 0.9).count() == 0
    assert S.matches_between(none, none.withColumnRenamed("id", "ref"), 0.9).count() == 0


def test_tiles_leave_few_pairs_and_lose_none():
    """of the turns next to none are left to compute, and of near copies none is lost."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = sorted({t for t in pq.read_table("/root/testdata/sf0.01/conversations.parquet").column("text").to_pylist() if t})
    tile = S._Alike(pa.table({"key": range(len(texts)), "text": texts}), 0.9)
    left = sum(len(tile._near(-1, tile._codes(t))) for t in texts) - len(texts)
    assert left < 0.002 * len(texts) ** 2
    for seed, longest, least in ((7, 12, 0.8), (8, 90, 0.9), (9, 6, 0.5)):
        texts = sorted(set(made(seed, 90, longest)) - {""})
        table = pa.table({"key": range(len(texts)), "text": texts})
        found = S._Alike(table, least).offer(table)
        pairs = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and max(ratio(x, y), ratio(y, x)) >= least}
        assert {(r["a"], r["b"]) for r in found.to_pylist()} == pairs and pairs


@pytest.mark.parametrize(("longest", "least"), [(60, 0.9), (12, 0.8)])
def test_levels_in_parts_lose_no_pair(spark, monkeypatch, longest, least):
    """texts on both sides of 200 letters, in levels of several parts, against all pairs; each pair is found once."""
    monkeypatch.setattr(S, "PART_ROWS", 30)
    texts = sorted(set(made(11, 240, longest)) - {""})
    rows = spark.createDataFrame(list(enumerate(texts)), "key bigint, text string")
    found = S.similar_texts(rows, least).collect()
    pairs = {(i, j): (ratio(x, y), ratio(y, x)) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and max(ratio(x, y), ratio(y, x)) >= least}
    assert {(r.a, r.b): (r.there, r.back) for r in found} == pairs and len(found) == len(pairs) > 50


def test_rows_are_made_once(spark):
    """texts come from a plan that is run once, not by each step."""
    made_rows = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made_rows.add(1)
        return "some text of letters " * (1 + i % 7) + "xyzvw"[i % 5]

    rows = spark.range(60).repartition(3).select("id", text.asNondeterministic()("id").alias("text"))
    assert S.nearest_by_sequence(rows, 0.9).count() == 60 and made_rows.value == 60
