"""Phrases and spelling groups against brute force, with nulls, long texts, repeats, empty tables and clashing columns."""

import collections
import random
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, score double, h bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 0.5, 2) for i, t, lang in rows], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_phrases(rows, least, percent, longest):
    import re

    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\v\f\r]", lowered(text)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in found.items():
        inside = lambda x: len(x) > len(g) and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1))
        if any(other == lang and inside(x) and 100 * b >= percent * a for (other, x), b in found.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine, 1)]
    return ranked


@pytest.mark.parametrize(("longest", "task", "slice_bytes"), [(3, 200_000, 2 << 20), (3, 2, 64), (4, 3, 7)])
def test_phrases(spark, monkeypatch, longest, task, slice_bytes):
    from tessera.llm import phrases as P

    monkeypatch.setattr(P, "SLICE", slice_bytes)
    rng = random.Random(longest)
    words = ["a", "B", "b", "été", "Ê", "x y", "the", "of", " ", "'"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\r,"]) for _ in range(rng.randrange(60))), rng.choice(["en", None, "und", "de"])) for i in range(60)]
    rows += [(1, "The Same Words", "fr")] * 12 + [(None, None, "en"), (2, "", "xx"), (3, " .,;\n", "yy"), (4, "of the " * 3000, "zz"), (5, "word", None)]
    got = P.collocations(docs(spark, rows), longest=longest, least=5, task=task)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_phrases(rows, 5, 50, longest))
    top = P.collocations(docs(spark, rows), longest=longest, least=5, top=2, task=task)
    assert sorted(map(tuple, top.collect())) == sorted(r for r in brute_phrases(rows, 5, 50, longest) if r[1] <= 2)
    assert P.collocations(docs(spark, rows).limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(3_000_000_000_000, 4_000_000_000_000, 5_000_000_000_000)], "a bigint, l bigint, r bigint")
    wide = {c: f"cast({c} as decimal(20, 0))" for c in "alr"}
    assert row.select(F.expr(f"(1000000 * {wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']})")).first()[0] == 450000


def brute_spelling(rows, least_letters, least_count, ratio):
    import re

    n = collections.Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    known = {w: k for w, k in n.items() if len(w) >= least_letters and k >= least_count}

    def near(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    nears = {w: [v for v in known if near(w, v)] for w in known}
    form = {}
    for w, others in nears.items():
        best = min(others, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= ratio * known[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), known[w], len(nears[w]), known[form[w]] if form[w] else -1) for w in known)


@pytest.mark.parametrize("at_once", [1 << 20, 5])
def test_spelling(spark, monkeypatch, at_once):
    from tessera.llm import spelling as S

    monkeypatch.setattr(S, "AT_ONCE", at_once)
    monkeypatch.setattr(S, "CHUNK", 50)
    monkeypatch.setattr(S, "COUNTED", 3)
    rng = random.Random(1)
    base = ["banana", "Éclair", "aaaaaa", "letters", "ÿÿÿÿÿÿ", "straße"]
    rows = []
    for i in range(150):
        words = [w for w in base for _ in range(rng.choice([1, 9]))]
        for _ in range(4):
            w = rng.choice(base)
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("ab") + w[k:], w[:k] + "b" + w[k + 1 :]]))
        rng.shuffle(words)
        rows.append((i, "".join(w + rng.choice([" ", "-", "1", "中", "\n"]) for w in words), None))
    rows += [(7, "Banana " * 20, "en"), (None, "letters", "en"), (None, None, None), (8, "", "en"), (9, "x" * 3000 + " ", "en"), (9, ("x" * 3000 + "y ") * 6, "en"), (10, ("x" * 3000 + " ") * 40, "en")] + [rows[0]] * 2
    got = S.spelling_groups(docs(spark, rows))
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n if r.form_n is not None else -1) for r in got.collect()) == brute_spelling(rows, 6, 5, 5)
    assert S.spelling_groups(docs(spark, rows).limit(0)).count() == 0


def test_neighbourhood_is_full():
    """Every word at one step is made once, and none else."""
    from tessera.llm import spelling as S

    letters = np.array(sorted(map(ord, "abcß")), np.uint32)
    for word in ("a", "aab", "abba", "ccccc", "ß"):
        made = [w for _, w in S.neighbours(S._points(word)[None, :], letters, lambda h: np.ones(len(h), bool))]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))}
        for c in "abcß":
            want |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
        assert sorted(made) == sorted(want - {word})
        hashes = []
        list(S.neighbours(S._points(word)[None, :], letters, lambda h: hashes.append(h) or np.zeros(len(h), bool)))
        assert sorted(np.concatenate(hashes).tolist()) == sorted(int(S.word_hashes(S._points(w)[None, :])[0]) for w in made)
