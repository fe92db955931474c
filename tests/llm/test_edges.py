"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_lines bigint, kept boolean, batch int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 0.5, 7, True, 1) for i, t, s in rows], SCHEMA)


LONG = "The same long line stands in many of the documents, word for word."
ODD = [(1, None, "b"), (2, "", "a"), (3, "  \n\t ", None), (4, "word", "a"), (4, "word", "a"), (None, LONG, "b"), (6, LONG + "\n" + LONG.upper() + " ", "a"), (7, LONG, None), (8, "x\n" + LONG, "c"), (9, LONG, "c"), (10, ("very long text " * 40_000).strip(), "d")]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_line_dedup(spark):
    from tessera.llm.line_dedup import LineRuns, dedup_lines

    for limit in (32 << 20, 0):  # broadcast, and shuffled
        out = dedup_lines(docs(spark, ODD), broadcast_bytes=limit)
        assert out.columns == [c for c in SCHEMA.replace(",", "").split()[::2] if c != "n_lines"] + ["n_lines", "n_dropped"]
        got = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())
        assert got[6, "", 2, 2] and got[7, "", 1, 1] and got[8, "x", 2, 1] and got[None, "", 1, 1]
        assert got[9, LONG, 1, 0] and got[1, "", 1, 0] and got[2, "", 1, 0] and got[4, "word", 1, 0] == 2
    assert dedup_lines(docs(spark, ODD).limit(0)).count() == 0
    few = dedup_lines(docs(spark, ODD[5:8]))
    assert few.agg(F.sum("n_dropped")).first()[0] == 0
    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(10 * b + d, h, 0) for d in range(3) for h in (b, 99)], "doc_id bigint, h1 bigint, h2 bigint"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.n_docs, r.top_doc) for r in runs.totals().collect()} == {(b, 3, 10 * b + 2) for b in range(5)} | {(99, 15, 42)}
    assert [r.h1 for r in runs.unseen(spark.createDataFrame([(1, 99, 0), (1, 77, 0)], "doc_id bigint, h1 bigint, h2 bigint")).collect()] == [77]


def test_mixing(spark):
    from tessera.llm.mixing import emit_mix, plan_mix

    rows = plan_mix(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s and r.taken <= 2 * r["size"] for r in rows for s, t in [targets[r.source]])
    assert plan_mix(docs(spark, ODD).limit(0)).count() == 0
    emitted = emit_mix(docs(spark, ODD))
    assert emitted.columns == docs(spark, ODD).columns
    size = lambda t: len((t or "").split())
    assert sum(size(r.text) for r in emitted.collect()) == sum(r.taken for r in rows)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_against_rounds(spark, seed):
    from tessera.llm.mixing import source_targets

    rng = random.Random(seed)
    sizes = {f"s{i}" if i else None: rng.choice([0, 1, 5, 40, 900, 12345]) for i in range(rng.randint(1, 9))}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def test_licenses(spark):
    from tessera.llm.license_scan import scan_licenses

    rows = [(1, None, "a"), (2, "", "a"), (3, "The MIT License, mit\nLICENSE mit  license", "a"), (3, "The MIT License, mit\nLICENSE mit  license", "a"), (4, "general public work license", "a"), (5, "Émit license; xmit license", "a"), (6, "This work is licensed under the (new) GNU General Public License, version 3", "a")]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in scan_licenses(docs(spark, rows)).orderBy("doc_id").collect()]
    assert got == [
        (1, 0, 0, None, None, "", ""), (2, 0, 0, None, None, "", ""), (3, 7, 3, 1, 5, "mit", "mit"), (3, 7, 3, 1, 5, "mit", "mit"), (4, 4, 0, None, None, "", ""),
        (5, 4, 0, None, None, "", ""), (6, 13, 1, 8, 8, "gpl", "gpl,gpl-3.0"),
    ]
    assert scan_licenses(docs(spark, rows).limit(0)).count() == 0


def test_short_templates_and_folding(spark):
    """One inserted word hides no short template; versions stay apart; only A-Z are folded; a naive scan finds the same places."""
    from tessera.llm.license_scan import BASE, scan_licenses, words_of

    rows = [
        (1, "licensed under the CC BY 4.0", "a"), (2, "licensed under CC BY-SA 4.0", "a"), (3, "licensed under a CC BY-SA 4.0", "a"), (4, "rights reserved", "a"), (5, "all rights reserved", "a"),
        (6, "This worK is licensed under the GNU General Public License version 3", "a"), (7, "released under MIT license", "a"), (8, "licensed under CC BY NC", "a"),
        (9, "MIT license " * 300 + "x mit the license general public apache license mit license", "a"),
    ]
    got = {r.doc_id: r for r in scan_licenses(docs(spark, rows)).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4, 5, 8)] == ["cc-by-4.0", "cc-by-sa-4.0", "cc-by-sa-4.0", "", "all-rights-reserved", ""]
    assert got[6].labels == "gpl" and got[7].labels == "mit"
    words = words_of(rows[-1][1])
    places = [i for p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    assert (got[9].n_base, got[9].first_word, got[9].last_word, got[9].base_labels) == (len(places), min(places), max(places), "apache,mit")
    own = scan_licenses(docs(spark, rows), templates={"Released UNDER, mit": "own"})
    assert "own" in next(r.labels for r in own.collect() if r.doc_id == 7)
    with pytest.raises(ValueError, match="no pair"):
        scan_licenses(docs(spark, rows), templates={"unlicense": "x"})


def exact_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_minhash_against_all_pairs(spark, k, percent):
    """Chains, dense groups whose members don't all resemble each other, short and empty texts."""
    from tessera.llm.minhash import keep_representatives, near_duplicates

    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "b a")], 5
    for size, edits in ((60, 4), (40, 9), (2, 1), (3, 3), (1, 0)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    chain = [word() for _ in range(100)]
    for _ in range(15):
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append((n, " ".join(chain)))
        n += 1
    df = docs(spark, [(i, t, "a") for i, t in rows])
    want = exact_components(rows, k, percent)
    for more in ({}, {"compared": 0, "broadcast_bytes": 0}):  # unsettled buckets pair by pair, and by prefixes
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k, percent, **more).collect()} == want
    left = keep_representatives(df, k, percent)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()})


def test_minhash_odd_rows(spark):
    from tessera.llm.minhash import near_duplicates

    rows = near_duplicates(docs(spark, ODD), 3, 85).collect()
    assert len(rows) == len(ODD)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[4, 1] == (4, True)
    assert {got[i, n] for i, n in got if i in (7, 9)} == {(7, True), (7, False)}
    assert near_duplicates(docs(spark, ODD).limit(0), 3, 85).count() == 0
    twice = [(5, "one two three four five"), (5, LONG), (3, "one two three four five"), (7, LONG), (7, LONG)]  # an id of two texts: each is judged by its own
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark, [(i, t, "a") for i, t in twice]), 3, 85).collect())
    n = len(LONG.split()) - 2
    assert got == {(5, 3, 3, False): 1, (3, 3, 3, True): 1, (5, n, 5, True): 1, (7, n, 5, False): 2}


def test_estimate_is_corrected_for_chance(spark):
    from tessera.llm.minhash import LONGS, estimated

    row = spark.createDataFrame([([0] * LONGS, [0] * LONGS), ([0] * LONGS, [-1] * LONGS)], "x array<bigint>, y array<bigint>")
    assert [r.e for r in row.select(estimated(F.col("x"), F.col("y")).alias("e")).collect()] == [1.0, pytest.approx(-1 / 15)]


@pytest.mark.parametrize(("block", "broadcast"), [(4096, 16 << 20), (3, 16 << 20), (3, 0)])
def test_topk(spark, block, broadcast):
    """One tile, several broadcast, several shuffled; repeated query ids with different vectors."""
    from tessera.llm.topk import top_k

    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (150, 20)))]
    rows += [(200 + i, rows[40][1]) for i in range(30)] + [(300, None), (301, [float("nan")] * 20), (302, [None] * 20), (303, [float("inf")] * 20), (320, [1.0]), (340, []), (None, rows[0][1]), (40, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    sound = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 20 == 0, k=5, query_block=block, broadcast_bytes=broadcast).collect()]
    want = []
    for q, v in sound:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in sound if i != q and len(c) == len(v))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert collections.Counter(got) == collections.Counter(want)
    assert sum(g[0] == 40 for g in got) == 10
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_token_counts_and_bpe(spark, path):
    from tokenizers import Tokenizer

    from tessera.llm.bpe import encode_documents
    from tessera.llm.token_counts import count_tokens

    library = Tokenizer.from_file(path)
    want = sorted((i is not None, i or 0, len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in ODD)
    for chunk in (32_768, 1000):
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in count_tokens(docs(spark, ODD), path, chunk=chunk, overlap=64).collect()) == want
    coded = encode_documents(docs(spark, ODD), path, with_ids=True).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in coded) == want
    assert all(library.decode(r.ids, skip_special_tokens=False) == r.decoded for r in coded)
    assert count_tokens(docs(spark, ODD).limit(0), path).count() == encode_documents(docs(spark, ODD).limit(0), path).count() == 0


PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'ll", "12", "é", "ñ", "<|endoftext|>", "<|end", "\xa0", "　", "\x1c", ".", "!!!", "😀", "the cat", "\r\n", "a" * 90, " " * 40, "ß", "漢字"]


def test_coders_on_random_texts(path):
    from tokenizers import Tokenizer

    from tessera.llm.bpe import PieceCoder, SegmentTreeBpe
    from tessera.llm.token_counts import ChunkedCounter

    definition = open(path, encoding="utf-8").read()
    library, coder = Tokenizer.from_file(path), PieceCoder(SegmentTreeBpe(definition), most=5000)
    counters = [ChunkedCounter(definition, c, o) for c, o in ((40, 8), (100, 16), (64, 2))]
    rng = random.Random(5)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    for text, (ids, back) in zip(made, coder.code([t.encode() for t in made])):
        known = library.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, known)).encode() and back.decode() == library.decode(known, skip_special_tokens=False)
    for c in counters:
        assert c.counts(made) == [len(library.encode(t, add_special_tokens=False)) for t in made]
    assert any(c.widened for c in counters)


def test_long_pretokens(path):
    """Unbroken letters, as many as no text should have."""
    import time

    from tokenizers import Tokenizer

    from tessera.llm.bpe import PieceCoder, SegmentTreeBpe

    coder, library, rng = PieceCoder(SegmentTreeBpe(open(path, encoding="utf-8").read())), Tokenizer.from_file(path), random.Random(2)
    made = ["".join(rng.choice("abcdeinorst") for _ in range(200_000)), "a" * 50_000, "x " + "é" * 30_000, "1" * 20_000 + " b"]
    start = time.perf_counter()
    got = [ids for ids, _ in coder.code([t.encode() for t in made])]
    assert time.perf_counter() - start < 20
    assert got == [",".join(map(str, library.encode(t, add_special_tokens=False).ids)).encode() for t in made]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": {"type": "BPE", "byte_fallback": True}}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}])
def test_other_vocabularies_are_errors(path, change):
    import json

    from tessera.llm.bpe import check_form

    data = json.load(open(path, encoding="utf-8"))
    check_form(data)
    with pytest.raises(ValueError, match="unsupported"):
        check_form(data | change)


def test_toxicity(spark):
    from tessera.llm.toxicity import EXCEPTIONS, Lexicon, drop_toxic, fit_lexicon, fold, score_toxicity

    assert fold("ID1OT idiоt ｉｄｉｏｔ id!ot").split() == ["idiot"] * 4
    lexicon = Lexicon(((fold("idiot"), 3.0), (" scu", 2.0), (fold("trash"), 2.0)))
    weigh = lexicon.matcher().weigh
    assert weigh("You 1d10t!")[:2] == (3.0, 1) and weigh("idiots")[:2] == (0, 0)
    assert weigh("scum")[:2] == (2.0, 1) and weigh("scu")[:2] == (0, 0)
    assert EXCEPTIONS[0] == "trash can" and weigh("the trash can")[:2] == (0, 0) and weigh("trash")[:2] == (2.0, 1)
    assert weigh("") == (0, 0, 0)
    rows = docs(spark, ODD)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = fit_lexicon(rows, labels, F.lit(True))  # no labels: the seed words
    assert score_toxicity(rows, model).filter("score >= 0 and score <= 1").count() == len(ODD)
    assert drop_toxic(rows, model).columns == rows.columns and drop_toxic(rows, model).count() == len(ODD)
    assert score_toxicity(rows.limit(0), model).count() == 0


def test_learnt_lexicon(spark):
    from tessera.llm.toxicity import fit_lexicon, score_toxicity

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    rows = []
    for i in range(300):
        w = [word() for _ in range(40)]
        if i % 5 == 0:
            w[3] = "zorg" + word()
            w[9] = "zorg" + word()
        elif i % 3 == 0:
            w[5] = "zorg"  # the stem alone is harmless
        rows.append((i, " ".join(w), "a"))
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = fit_lexicon(df, labels, F.col("doc_id") % 2 == 0)
    got = {r.doc_id: r.predicted for r in score_toxicity(df, model).collect()}
    assert sum(got[i] != (i % 5 == 0) for i in range(300)) <= 3


def test_lexicon_has_no_cap(spark):
    """Far more features that pass the test than the lexicon once could hold; equal texts of both labels count as toxic once."""
    from tessera.llm.toxicity import fit_lexicon, select_entries, tested

    counts = spark.range(300_000).select(F.concat(F.lit(" w"), F.col("id"), F.lit(" ")).alias("feature"), F.lit(50).alias("t"), F.when(F.col("id") < 260_000, 0).otherwise(50).alias("c"))
    assert tested(counts, 100, 1000, 300_000).count() == 260_000
    found = [tuple(r) for r in tested(counts.filter("id % 50 = 0"), 100, 1000, 300_000).collect()]
    assert len(select_entries(found)) == len(found) == 5200
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(4))
    rows = [(i, f"zorgan {word(i)}" if i % 2 else word(i), "a") for i in range(60)] + [(100 + i, f"zorgan {word(i)}", "a") for i in range(1, 60, 2)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100 + i, 0) for i in range(1, 60, 2)], "doc_id bigint, toxic int")
    first = [fit_lexicon(docs(spark, rows), labels, F.lit(True)) for _ in range(2)]
    assert first[0] == first[1] and any(" zorgan ".startswith(e) for e, _ in first[0].entries)


def test_many_exceptions():
    """Hits inside exception phrases, as a plain test of all against all finds them, in time that grows with the text."""
    import time

    from tessera.llm.toxicity import Lexicon, fold

    lexicon = Lexicon(((fold("trash"), 2.0), (" clo", 1.0)), tuple(fold(e) for e in ("trash can", "big trash can lid", "circus clown")))
    matcher, rng = lexicon.matcher(), random.Random(8)
    for _ in range(50):
        text = " ".join(rng.choice(["trash", "can", "big", "lid", "clown", "circus", "x"]) for _ in range(40))
        folded = fold(text)
        spans = [(i, i + len(e)) for e in lexicon.exceptions for i in range(len(folded)) if folded.startswith(e, i)]
        hits = [(i, i + len(e)) for e in (" trash ",) for i in range(len(folded)) if folded.startswith(e, i)] + [(i, i + 4) for i in range(len(folded)) if folded.startswith(" clo", i)]
        assert matcher.weigh(text)[1] == sum(not any(a <= x and y <= b for a, b in spans) for x, y in hits)
    start = time.perf_counter()
    assert matcher.weigh("trash can trash " * 100_000)[1] == 100_000
    assert time.perf_counter() - start < 10


def test_quality_learns_from_long_texts(spark):
    """One kind of documents has very many lines; the fit sees them, and its sample is bounded by lines as by documents."""
    from tessera.llm import quality_crf as Q
    from tessera.llm._store import Scratch

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = lambda n: "\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(n))
    bad = lambda n: "\n".join("%$#@ 12 || 99 &&" for _ in range(n))
    rows = [(i, bad(600) if i % 2 else good(5), "a") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    model = Q.fit_quality(docs(spark, rows), labels, F.col("doc_id") < 40)
    assert {r.doc_id: r.predicted for r in Q.score_quality(docs(spark, rows), model, 0.5).collect()} == {i: 1 - i % 2 for i in range(60)}
    sample = docs(spark, rows).select("text", F.lit(1).alias("y"))
    some = Q._bounded(sample, Scratch(spark, "t"), 3000)
    assert 3000 <= some.agg(F.sum("n")).first()[0] < 3600 and {len(r.text.split("\n")) for r in some.collect()} <= {5, 600}


def test_quality(spark):
    from tessera.llm import quality_crf as Q

    rng = np.random.default_rng(0)
    field = Q.Field(rng.normal(size=Q.WIDTH), rng.normal(size=(2, 2)))
    for n in (1, 2, 5):
        x = rng.normal(size=(n, Q.WIDTH))
        states = [[(s >> i) & 1 for i in range(n)] for s in range(1 << n)]
        weight = [np.exp(sum(x[i] @ field.w * s[i] for i in range(n)) + sum(field.t[a, b] for a, b in zip(s, s[1:]))) for s in states]
        want = [sum(w for w, s in zip(weight, states) if s[i]) / sum(weight) for i in range(n)]
        longer = rng.normal(size=(2 * n, Q.WIDTH))
        assert np.allclose(field.marginals([longer, x])[1], want)
    model = Q.fit_quality(docs(spark, ODD), spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int"), F.lit(True))
    out = Q.score_quality(docs(spark, ODD), model)
    assert out.filter("score >= 0 and score <= 1").count() == len(ODD)
    assert Q.score_quality(docs(spark, ODD).limit(0), model).count() == 0


def pairs(prints, is_query, k=1, **more):
    from tessera.llm import chroma as C

    return C.align(prints.filter(is_query), prints, k=k, **more).collect()


@pytest.mark.parametrize("broadcast", [16 << 20, 0])
def test_chroma(spark, broadcast):
    from tessera.llm import chroma as C

    rng = random.Random(4)
    words = [str(rng.random()) for _ in range(120)]
    whole, part, other = " ".join(words), " ".join(words[30:80]), " ".join(str(rng.random()) for _ in range(60))
    rows = spark.createDataFrame([(0, whole, 1, 2), (1, part, 1, 2), (2, other, 1, 2), (3, None, 1, 2), (4, "", 1, 2), (5, "one", 1, 2), (6, part, 1, 2), (7, whole, 1, 2), (None, whole, 1, 2)], "id bigint, t string, rank int, votes int")
    prints = C.fingerprints(rows, F.col("t"), C.spoken)
    found = pairs(prints, F.lit(True), broadcast_bytes=broadcast)
    got = {r.id: r for r in found}
    assert len(found) == 9
    assert (got[1].match_id, got[1].shift) == (0, 30) == (got[6].match_id, got[6].shift)  # as good as its copy, and smaller
    assert got[0].match_id == 7 and got[7].match_id == 0 and got[0].bit_error == 0
    assert got[2].match_id is None and got[3].match_id is None and got[4].n_frames == 0 and got[None].match_id is None
    second = {(r.id, r.match_id): r.shift for r in pairs(prints.filter("id < 2"), F.col("id") == 1, k=2)}
    assert second == {(1, 0): 30}
    assert pairs(prints.limit(0), F.lit(True)) == []
    image = np.random.default_rng(0).random((20, 12)).astype(np.float32)
    a, b = C.fingerprint(image), C.fingerprint(np.concatenate([image[5:], image[:5]]))
    assert (a[5:] == b[: len(a) - 5]).all()  # integers depend on their own frames alone
    assert len(C.fingerprint(image[: C.SPAN - 1])) == 0


def test_chroma_copies(spark):
    """Every member of a class of copies can be a match, the smallest first; own keys only if asked for; keys of two columns."""
    from tessera.llm import chroma as C

    rng = random.Random(9)
    text = " ".join(str(rng.random()) for _ in range(40))
    rows = spark.createDataFrame([(a, b, text) for a, b in ((0, 0), (0, 12_345), (1, 2_345), (7, 1), (8, 0))] + [(20, i, " ".join(str(rng.random()) for _ in range(30))) for i in range(4)], "a bigint, b bigint, t string")
    prints = C.fingerprints(rows, F.col("t"), C.spoken, ("a", "b"))
    asked = prints.filter("a = 8 or a = 0 and b = 0")
    for k in (1, 2, 3, 9):
        got = collections.defaultdict(list)
        for r in C.align(asked, prints, ("a", "b"), k=k).orderBy("rank").collect():
            got[r.a, r.b].append((r.match_a, r.match_b))
        assert got[8, 0] == [(0, 0), (0, 12_345), (1, 2_345), (7, 1)][:k] and got[0, 0] == [(0, 12_345), (1, 2_345), (7, 1), (8, 0)][:k]
    own = C.align(asked, prints, ("a", "b"), k=1, own=True).collect()
    assert {(r.a, r.match_a, r.match_b) for r in own} == {(8, 0, 0), (0, 0, 0)}


def test_chroma_silence():
    """Frequent integers are counted by convolution: the same votes as pair by pair, in time that doesn't grow with the square."""
    import time

    from tessera.llm import chroma as C

    rng = np.random.default_rng(6)
    queries = [rng.choice([5, 5, 5, 5, 9, 11, 70], n).astype(np.int32) for n in (900, 40, 1500)] + [np.full(700, 5, np.int32)]
    frames = rng.choice([5, 5, 5, 9, 12, 70], 1100).astype(np.int32)
    want = collections.Counter(((q << 32) + j - i + (1 << 31)) for q, x in enumerate(queries) for i in range(len(x)) for j in np.flatnonzero(frames == x[i]).tolist())
    assert dict(zip(*(x.tolist() for x in C.Aligner(queries, 4)._votes(frames)))) == want
    hour = np.full(56_000, 5, np.int32)
    start = time.perf_counter()
    assert list(C.Aligner([hour, hour], 4).align(hour, 0.25)) == [(q, 0, 56_000, 0.0, False) for q in (0, 1)]
    assert time.perf_counter() - start < 10


def test_chroma_short_and_shared(spark):
    from tessera.llm import chroma as C

    rng = random.Random(11)
    draw = lambda n: [str(rng.random()) for _ in range(n)]
    eight, clip = draw(8), draw(40)
    texts = [eight, eight, [*draw(50), *eight, *draw(50)], [*draw(150), *clip, *draw(150)], [*draw(60), *clip, *draw(200)], draw(5)]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*texts, texts[5]])], "id bigint, t string")
    prints = C.fingerprints(rows, F.col("t"), C.spoken)
    got = {}
    for r in pairs(prints, F.lit(True), k=3):
        got.setdefault(r.id, {})[r.match_id] = r
    assert 0 < got[0][1].n_frames < 4
    assert got[0][1].bit_error == 0 == got[1][0].bit_error and got[2][0].votes == got[0][1].n_frames  # fewer integers than votes
    assert got[0][2].shift == 50
    assert got[3][4].shift == -90 and got[4][3].shift == 90 and got[3][4].clip and got[3][4].bit_error <= 0.25 and got[3][4].votes >= 30  # a clip of two recordings
    assert set(got[5]) == set(got[6]) == {None} and got[5][None].n_frames == 0


def test_align_against_every_offset():
    """Offset, votes and bit error of the best match, against a plain test of all offsets."""
    from tessera.llm import chroma as C

    rng = np.random.default_rng(12)
    frames = rng.integers(0, 1 << 31, 300).astype(np.int32)
    queries = []
    for start, size in ((20, 60), (0, 300), (250, 50), (100, 12)):
        x = frames[start : start + size].copy()
        x[::3] ^= 1 << 7
        queries.append(x)
    got = {q: (d, votes, errors) for q, d, votes, errors, _ in C.Aligner(queries, 4).align(frames, 0.25)}
    for q, x in enumerate(queries):
        tested = []
        for d in range(-len(x) + 1, len(frames)):
            a, b = max(0, d), min(len(frames), d + len(x))
            same = frames[a:b] ^ x[a - d : b - d]
            if (same == 0).sum() >= 4:
                tested.append((float(np.bitwise_count(same.view(np.uint32)).sum()) / (32 * (b - a)), -int((same == 0).sum()), d))
        errors, votes, d = min(tested)
        assert got[q] == (d, -votes, errors)


def test_scratch_tables_go(spark, tmp_path):
    """Tables are deleted when their operator's result has been written; a missing shared folder is an error on a cluster."""
    import os
    from types import SimpleNamespace

    from tessera.llm._store import KEY, Scratch, released, shared_dir
    from tessera.llm.line_dedup import dedup_lines

    base = spark.conf.get(KEY).removeprefix("file://")
    own = Scratch(spark, "own")
    before, tables = set(os.listdir(base)), len(spark.catalog.listTables())
    with released():
        kept = own.cut(dedup_lines(docs(spark, ODD)))
    assert set(os.listdir(base)) == before and len(spark.catalog.listTables()) == tables and kept.count() == len(ODD)
    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="share"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_minhash_of_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64, whatever its base."""
    from tessera.llm.minhash import near_duplicates

    for n in (1024, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        other = word.translate(str.maketrans("ab", "ba"))
        rows = [(1, f"one two three four {word}"), (2, f"one two three four {other}"), (3, word), (4, other), (5, word.upper())]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=50).collect()}
        assert got == {1: (3, 1), 2: (3, 1), 3: (1, 3), 4: (1, 4), 5: (1, 3)}
        got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, percent=85).collect()}
        assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_shingles_of_long_texts():
    """Texts read piece by piece have the sets of texts read at once; little is held beside them."""
    import resource

    from tessera.llm import minhash

    rng = random.Random(3)
    text = " ".join(rng.choice(["of", "thé", "Word", "x" * 40]) + str(rng.randrange(300)) for _ in range(700_000)).encode()
    assert len(text) > 2 * minhash.SLICE_BYTES
    shingler = minhash.Shingler(3)
    first, words = shingler.hashed(text)
    assert (shingler._long(text) == words).all() and len(first) == 700_000
    whole = shingler.sets([text, b"", b"one"])
    assert (shingler.sets([text])[0] == whole[0]).all() and [len(x) for x in whole[1:]] == [0, 1]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    shingler.sets([b"abcd efg " * 11_000_000])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB, for a text of 99 MB


def test_bpe_memo_is_bounded(path):
    from tessera.llm.bpe import ENTRY_BYTES, PieceCoder, SegmentTreeBpe

    with open(path, encoding="utf-8") as file:
        coder = PieceCoder(SegmentTreeBpe(file.read()), most=100_000)
    for i in range(60):
        list(coder.code([b" ".join(b"w%d\n" % (1000 * i + j) for j in range(200))]))
        assert sum(len(k) + ENTRY_BYTES for k in coder.ids) <= coder.held <= 100_000 + 200 * (ENTRY_BYTES + 20)


def test_license_rows_repeat(spark):
    """Rows are told apart by id and text, so that no attempt of a task numbers them otherwise; equal rows come back as often as they are there."""
    from tessera.llm.license_scan import scan_licenses

    text = "the MIT License, or under the mit license. " * 3
    rows = [(1, text)] * 3 + [(1, "apache license"), (1, None), (1, ""), (None, text), (None, text), (2, ("word " * 200_000) + text)]
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.base_labels) for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == {(1, 24, 6, "mit"): 3, (1, 2, 1, "apache"): 1, (1, 0, 0, ""): 2, (None, 24, 6, "mit"): 2, (2, 200_024, 6, "mit"): 1}
    plan = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan
