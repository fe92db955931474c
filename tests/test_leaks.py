"""The leak queries against brute force, on small tables of our own and on the smallest tables."""

import random
from difflib import SequenceMatcher

from tessera.operators import leakage as L
from tessera.plans import leaks


def _texts(n, seed, letters="aeinrst lgdzxq", low=0, high=420):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, [9] * 8 + [2] * 3 + [0.2] * 3, k=rng.randint(low, high))).strip() for _ in range(n)]


def _save(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _near(text, rng):
    at = rng.randrange(len(text))
    return text[:at] + "zq" + text[at + 1 :]


def test_bounds_lose_nothing():
    import numpy as np

    a, b = ["", *_texts(25, 1)], ["", *_texts(60, 2), *_texts(6, 3, low=500, high=2500)]
    b += [a[3] + b[5], "zz " + a[5], a[7]]
    known = L._Sequences(a)
    for text in b:
        got = known.bounds(text, np.full(len(a), -0.5))
        ratios = [SequenceMatcher(None, x, text).ratio() for x in a]
        assert all(g >= r - 1e-12 for g, r in zip(got, ratios))
        assert all(2 * n >= r * (len(x) + len(text)) - 1e-9 for x, r, n in zip(a, ratios, known.common(text, list(range(len(a))))))
    assert L._Sequences(["abcbdab", "", "xaxb"]).common("bdcaba", [0, 1, 2]) == [4, 0, 2]


def test_seq_ratio_meets_every_turn(spark, tmp_path):
    rng = random.Random(5)
    items = _texts(20, 6, low=40)
    turns = _texts(80, 7) + [_near(items[i], rng) for i in range(9)] + ["q" + items[3][1:], items[4]]
    where = _save(
        spark, tmp_path,
        benchmark=spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"),
        conversations=spark.createDataFrame([(i // 4, i % 4, "user", t) for i, t in enumerate(turns)] + [(99, 0, "user", None)], "conv_id bigint, turn int, role string, text string"),
    )
    got = {(r.ref, r.id): r.ratio for r in leaks.leak_seq_ratio(spark, where).collect()}
    want = {(i, f"{j // 4}/{j % 4}"): round(s, 6) for i, a in enumerate(items) for j, b in enumerate(turns) if (s := SequenceMatcher(None, a, b).ratio()) >= 0.8}
    planted = {f"planted/{i}": items[i] + " zz" for i in (2, 9, 16)}
    want |= {(i, p): round(s, 6) for i, a in enumerate(items) for p, b in planted.items() if (s := SequenceMatcher(None, a, b).ratio()) >= 0.8}
    assert got == want and len(got) >= 8
    assert (3, f"{89 // 4}/{89 % 4}") in got  # they differ in the first letter


def test_audit_meets_every_document(spark, tmp_path):
    rng = random.Random(8)
    items = _texts(12, 9, low=30)
    docs = _texts(90, 10, high=900) + [_near(items[i], rng) for i in range(4)] + [items[5], items[5], ""]
    where = _save(
        spark, tmp_path,
        benchmark=spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"),
        documents=spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3),
    )
    grams = lambda t: {t[i : i + 3] for i in range(max(1, len(t) - 2))}
    want = {}
    for i, a in enumerate(items):
        scored = []
        for j, b in enumerate(docs):
            g, h = grams(a), grams(b)
            scored.append((-SequenceMatcher(None, a, b).ratio(), -len(g & h) / len(g | h), j))
        r, g, j = min(scored)
        want[i] = (j, round(-r, 6), round(-g, 6), -r >= 0.9 or -g >= 0.7)
    got = {r.id: (r.ref, r.ratio, r.gram, r.leaks) for r in leaks.leak_audit(spark, where).collect()}
    assert got == want
    assert got[5] == (94, 1.0, 1.0, True) and sum(x[3] for x in got.values()) >= 3



def _ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def _words(t):
    return set(t.split())


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_measures_apart_and_sources(spark):
    """L1, L5, L6, J7 against all pairs."""
    rng = random.Random(13)
    items = _texts(14, 14, low=30, high=120)
    turns = [t for t in _texts(50, 15, low=20, high=140) if t] + [_near(items[2], rng), items[5], items[5] + " qq"]
    rows = spark.createDataFrame(list(enumerate(items)), "id bigint, text string")
    refs = spark.createDataFrame(list(enumerate(turns)), "ref bigint, text string").repartition(3)
    steps = (1.0, 0.9, 0.5, 0.2)
    got = {(r.measure, r.threshold): r.n for r in L.measures_apart(rows, refs, steps).collect()}
    best = {"tokens": [max(_jaccard(_words(a), _words(b)) for b in turns) for a in items], "sequence": [max(_ratio(a, b) for b in turns) for a in items]}
    assert got == {(m, s): sum(x >= s - 1e-9 for x in v) for m, v in best.items() for s in steps}
    halves = {"one": refs.filter("ref % 2 = 0"), "two": refs.filter("ref % 2 = 1")}
    for r in L.audit_sources(rows, halves, "bench").collect():
        mine = [(_ratio(" ".join(items[r.id].split()), " ".join(t.split())), -j) for j, t in enumerate(turns) if (j % 2 == 0) == (r.source == "one")]
        assert round(max(mine)[0], 9) == round(r.ratio, 9)
    label = lambda t: t.selectExpr("*", "length(text) < 60 as short")
    found = {r.check: (r.found, r.passed) for r in L.frozen_audit(label(refs.withColumnRenamed("ref", "id")), label(rows), "short").collect()}
    assert found["shared texts"] == (1.0, False) and found["shared ids"] == (14.0, False) and found["largest sequence ratio"] == (1.0, False) and found["repeated ids in train"] == (0.0, True)
    words = lambda t, a, b: t.selectExpr(f"{a} as {b}", "split(text, ' ') as s").selectExpr(b, "array_remove(array_distinct(s), '') as tokens")
    top = L.largest_similarity(words(refs, "ref", "id"), words(rows, "id", "ref")).first()
    assert (top.ref, top.sim) == (5, 1.0)


def test_nearest_peers(spark):
    """J9 against all pairs: copies, chains, a token that all have, and rows without tokens."""
    rng = random.Random(16)
    base = [f"w{i}" for i in range(40)]
    sets = [["all", *base[:-k]] if k else ["all", *base] for k in (0, 0, 1, 2, 5, 9)] + [["all", *(f"x{rng.randrange(60)}" for _ in range(rng.randint(1, 30)))] for _ in range(60)] + [[], None, ["all"], ["all"]]
    sets = [None if s is None else sorted(set(s)) for s in sets]
    rows = spark.createDataFrame(list(enumerate(sets)) + [(None, ["all"])], "id bigint, tokens array<string>").repartition(4)
    for least in (0.9, 0.5):
        want = {}
        for i, a in enumerate(sets):
            near = [(-round(_jaccard(set(a), set(b)), 9), j) for j, b in enumerate(sets) if i != j and a and b]
            if near and -min(near)[0] >= least:
                want[i] = (min(near)[1], -min(near)[0])
        assert {r.id: (r.peer, r.sim) for r in L.nearest_peers(rows, least).collect()} == want and want


def test_nearest_peers_shuffle_less_than_the_tokens(spark):
    """occurrences of tokens aren't shuffled, and sets are sent only for pairs that may be near."""
    rng = random.Random(18)
    sets = [sorted({f"word{rng.randrange(20_000)}" for _ in range(300)}) for _ in range(400)]
    sets[7] = [*sets[3], "more"]
    rows = spark.createDataFrame(list(enumerate(sets)), "id bigint, tokens array<string>").repartition(4).cache()
    rows.count()
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    assert {(r.id, r.peer) for r in L.nearest_peers(rows, 0.9).collect()} == {(3, 7), (7, 3)}
    assert shuffled() - before < sum(len(t) for s in sets for t in s)
    rows.unpersist()


def test_common_tokens_keep_their_order():
    """a token of thousands of sets comes behind one of hundreds in every set's prefix, and pairs no one."""
    import numpy as np
    import pyarrow as pa

    sets = [[1 << 40, (1 + i % 9) << 41, (10 + i % 3) << 42] for i in range(6000)]  # hashes by which the commonest would be first
    parts = [next(L._tallied(iter([pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64()))], names=["hashes"])]))) for x in (sets[:1000], sets[1000:])]
    blocks = L._summed(pa.Table.from_batches(parts)).to_pylist()
    known = np.frombuffer(blocks[0]["uses"], "u1")
    place = lambda h: h >> 64 - L.PLACES
    assert known[place(1 << 40)] > known[place(10 << 42)] > known[place(1 << 41)] > 64
    n = np.arange(1, 1 << 20)
    assert (np.diff(L._steps(n).astype(int)) >= 0).all() and (L._steps(n[:64]) == n[:64]).all()


def test_hold_out_least_similar(spark):
    from pyspark.sql import functions as F

    from tessera.operators.build import hold_out_least_similar

    rng = random.Random(17)
    items = _texts(16, 18, low=30, high=90)
    items[7] = _near(items[3], rng)
    augmented = _texts(20, 19, low=30, high=90) + [_near(items[1], rng)]
    rows = spark.createDataFrame([(i, t, i % 2, "extra") for i, t in enumerate(items)], "id bigint, text string, kind int, ref string")
    out = hold_out_least_similar(rows, spark.createDataFrame(list(enumerate(augmented)), "id bigint, text string"), "kind", F.lit(3), kind="leak").collect()
    peer = {i: max(_ratio(a, b) for j, b in enumerate(items) if j != i) for i, a in enumerate(items)}
    aug = {i: max(_ratio(a, b) for b in augmented) for i, a in enumerate(items)}
    assert {r.id: (round(r.peer_similarity, 9), round(r.aug_similarity, 9), r.near_duplicate) for r in out} == {i: (round(peer[i], 9), round(aug[i], 9), peer[i] >= 0.9) for i in peer}
    for kind in (0, 1):
        order = sorted((peer[i] >= 0.9, aug[i], peer[i], i) for i in peer if i % 2 == kind)
        assert {r.id for r in out if r.kind == kind and r.held_out} == {o[-1] for o in order[:3]}


def test_best_ratios_side_by_side(monkeypatch):
    """F8: a reference meets all rows side by side, whatever the rounds; few pairs are computed one by one; results are difflib's."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(27)
    rows = ["", *_texts(30, 28, low=40, high=190), *_texts(6, 29, low=200, high=420), "ab" * 30, "é😀 " * 9]
    refs = ["", *_texts(30, 30, low=40, high=190), *_texts(6, 31, low=200, high=420), _near(rows[3], rng), rows[5][::-1], rows[7] + rows[8], "ba" * 40]
    known, ratios = L._Sequences(rows), {t: [_ratio(a, t) for a in rows] for t in refs}
    for rounds, few in ((0, 0), (1, 0), (3, 5), (1000, 0)):
        monkeypatch.setattr(L._Sequences, "ROUNDS", rounds)
        monkeypatch.setattr(L._Sequences, "FEW", few)
        for text, want in ratios.items():
            for least in (np.full(len(rows), -0.5), np.full(len(rows), 0.4), np.array(want)):
                assert dict(known.reaching(text, range(len(rows)), least)) == {k: r for k, r in enumerate(want) if r >= least[k]}
    monkeypatch.undo()
    single, one = [0], L._Ratio.reaching
    monkeypatch.setattr(L._Ratio, "reaching", lambda self, *a: single.__setitem__(0, single[0] + 1) or one(self, *a))
    closest = L._Closest(pa.table({"id": range(len(rows)), "t": rows}), {"id": pa.int64(), "ref": pa.int64(), "ratio": pa.float64(), "gram": pa.float64()}, True)
    closest.offer(pa.table({"ref": range(len(refs)), "t": refs}))
    assert [r["ratio"] for r in closest.found().to_pylist()] == [max(ratios[t][k] for t in refs) for k in range(len(rows))]
    assert single[0] <= 0.1 * len(rows) * len(refs)


def test_ratios_are_those_of_difflib_or_below_the_bound(monkeypatch):
    """``reaching`` gives difflib's ratio, with popular letters left out and without, or says that the bound isn't reached."""
    rng = random.Random(20)
    a = ["", *_texts(14, 21), *_texts(4, 22, letters="ab cdefghijklm")]
    b = ["", *_texts(14, 23), *_texts(4, 24, low=500, high=900)]
    b += [_near(a[3], rng), a[3], "zz " + a[5], a[5][:40] + "q" + a[5][41:]]
    known = L._Sequences(a)
    dropped = 0
    for blocks in (1, 3, 10_000):
        monkeypatch.setattr(L._Ratio, "BLOCKS", blocks)
        for text in b:
            match, most = L._Ratio(text, known._codes(text)), known.common(text, list(range(len(a))))
            for k, x in enumerate(a):
                want = _ratio(x, text)
                for least in (-0.5, 0.4, want, 0.9):
                    got = match.reaching(x, known.codes(k), known.bits[k], most[k], least)
                    assert got == want or got is None and want < least
                    dropped += got is None
    assert dropped > 500


def test_most_pairs_are_dropped_before_difflib(monkeypatch):
    """Of the pairs that the bounds leave, next to none are computed by difflib."""
    import pyarrow as pa

    exact, calls = L._Ratio.exact, []
    monkeypatch.setattr(L._Ratio, "exact", lambda self, other: calls.append(1) or exact(self, other))
    items, turns = _texts(20, 25, low=60, high=199), _texts(120, 26, low=60, high=199)
    kinds = {"id": pa.int64(), "ref": pa.int64(), "ratio": pa.float64(), "gram": pa.float64()}
    tile = L._Closest(pa.table({"id": range(20), "t": items}), kinds, True)
    tile.offer(pa.table({"ref": range(120), "t": turns}))
    got = {r["id"]: r["ratio"] for r in tile.found().to_pylist()}
    assert got == {i: max(_ratio(a, b) for b in turns) for i, a in enumerate(items)}
    assert len(calls) < 0.05 * len(items) * len(turns)


def _tile(items, turns, **how):
    import pyarrow as pa

    kinds = {"id": pa.int64(), "ref": pa.int64(), "ratio": pa.float64(), "gram": pa.float64()}
    tile = L._Closest(pa.table({"id": range(len(items)), "t": items}), kinds, True, **how)
    for i in range(0, len(turns), 40):
        tile.offer(pa.table({"ref": range(i, min(i + 40, len(turns))), "t": turns[i : i + 40]}))
    return {r["id"]: r["ratio"] for r in tile.found().to_pylist()}


def test_largest_ratio_alone(monkeypatch):
    """where only the largest ratio of all counts, it bounds every row's pairs."""
    reaching, calls = L._Ratio.reaching, []
    monkeypatch.setattr(L._Ratio, "reaching", lambda self, *of: calls.append(1) or reaching(self, *of))
    items, turns = _texts(20, 27, low=60, high=150), _texts(150, 28, low=60, high=150)
    all_ = _tile(items, turns)
    each, calls[:] = len(calls), []
    assert max(_tile(items, turns, largest=True).values()) == max(all_.values()) == max(_ratio(a, b) for a in items for b in turns)
    assert len(calls) < 0.5 * each
    assert _tile(["", "abc"], ["", "abd"], largest=True)[0] == 1.0


def test_steps_alone(monkeypatch):
    """where only the steps count, a row looks for its next step, and for nothing beyond the last."""
    reaching, calls = L._Ratio.reaching, []
    monkeypatch.setattr(L._Ratio, "reaching", lambda self, *of: calls.append(1) or reaching(self, *of))
    items, turns = _texts(20, 29, low=60, high=150), _texts(150, 30, low=60, high=150)
    turns += [items[2], items[3] + "zq", items[4][:50]]
    best = {i: max(_ratio(a, b) for b in turns) for i, a in enumerate(items)}
    all_ = _tile(items, turns)
    each, calls[:] = len(calls), []
    steps = (1.0, 0.6, 0.3)
    got = _tile(items, turns, steps=steps)
    assert {i: [r >= s for s in steps] for i, r in got.items()} == {i: [r >= s for s in steps] for i, r in best.items()} and all_ == best
    assert len(calls) < 0.5 * each


def test_measures_apart_uses_steps(spark, monkeypatch):
    """F2."""
    asked = []
    plain = L.audit
    monkeypatch.setattr(L, "audit", lambda *a, **k: asked.append(k.get("steps")) or plain(*a, **k))
    rows = spark.createDataFrame([(1, "abcd efgh")], "id bigint, text string")
    refs = spark.createDataFrame([(7, "abcd efgx"), (8, None)], "ref bigint, text string")
    got = {(r.measure, r.threshold): r.n for r in L.measures_apart(rows, refs, (1.0, 0.8)).collect()}
    assert got == {("sequence", 0.8): 1, ("sequence", 1.0): 0, ("tokens", 0.8): 0, ("tokens", 1.0): 0} and asked == [(1.0, 0.8)]


def test_seq_ratio_needs_no_index(spark, tmp_path, monkeypatch):
    """the benchmark is a stated set, whose tiles meet all turns; no cells are joined."""
    from tessera.operators import sequences

    monkeypatch.setattr(sequences, "candidates", None)
    items = ["open the door", "", "call Lan at eight"]
    where = _save(
        spark, tmp_path,
        benchmark=spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"),
        conversations=spark.createDataFrame([(0, i, "user", t) for i, t in enumerate(["Open the doors", None, "", "call Lan at nine", "x"])], "conv_id bigint, turn int, role string, text string"),
    )
    got = {(r.ref, r.id): r.ratio for r in leaks.leak_seq_ratio(spark, where).collect()}
    assert got == {(0, "0/0"): round(_ratio("open the door", "open the doors"), 6), (1, "0/2"): 1.0, (2, "planted/2"): round(_ratio("call lan at eight", "call lan at eight zz"), 6)}
