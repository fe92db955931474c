"""Personal data: patterns against plain regular expressions, the tagger against enumeration, slopes, windows and held-out spellings."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tests.conftest import DATA
from tessera.llm import pii as P
from tessera.llm._tagger import Tagger, padded, symbols


def plain_spans(text):
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def right(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            doubled = [d if i % 2 == 0 else (2 * d if 2 * d < 10 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == 0 or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if right(k, m.group())]


def test_base_spans():
    rng = random.Random(4)
    bits = ["a", "b.c", "@", "@x", ".com", "1", "25", "255", "256", "0007", ".", "..", "-", " ", "+", "+1", "(", ")", "4111111111111111", "é", "\n", "%", "4111 1111-1111 1111", "123-45", "+1 (743) 555-3824", "1.2.3.4", "1.2.3.4.5.6.7.8", "٣"]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert P.base_spans(text) == plain_spans(text), text
    for text in ("1" * 5000, "1." * 5000, "a" * 5000 + "@", "@" * 5000, "+" * 3000 + "1" * 3000):
        assert P.base_spans(text) == plain_spans(text)


def test_slopes_and_marginals():
    """Slopes against differences, P(tag) and the best path against all paths."""
    rng = np.random.default_rng(1)
    tagger = Tagger(2, 3, 4)
    for k in ("trans", "start", "c"):
        tagger.w[k] = rng.normal(size=tagger.w[k].shape).astype(np.float32)
    x, lengths = padded([np.array([1, 2, 3, 131]), np.array([6, 7])])
    tags, _ = padded([np.array([0, 1, 2, 3]), np.array([1, 0])])
    slopes = tagger.slopes(x, lengths, tags)
    for k, v in tagger.w.items():
        flat = v.reshape(-1)
        rows = (1, 6, 131) if k == "emb" else range(0, flat.size, max(1, flat.size // 9))
        for i in (r * v.shape[1] for r in rows) if k == "emb" else rows:
            if (k == "trans" and not tagger.allowed.reshape(-1)[i]) or (k == "start" and not tagger.begins[i]):
                continue
            old, moved = flat[i], []
            for step in (0.02, -0.02):
                flat[i] = old + step
                moved.append(-tagger.log_likelihood(x, lengths, tags).mean())
            flat[i] = old
            assert (moved[0] - moved[1]) / 0.04 == pytest.approx(slopes[k].reshape(-1)[i], abs=2e-3)
    p = tagger.marginals(tagger.emissions(x, lengths), lengths)
    for r, n in enumerate(lengths.tolist()):
        paths = [y for y in itertools.product(range(5), repeat=n) if tagger.begins[y[0]] and all(tagger.allowed[a, b] for a, b in zip(y, y[1:]))]
        weight = {y: float(np.exp(tagger.log_likelihood(x[r : r + 1, :n], lengths[r : r + 1], np.array([y])))[0]) for y in paths}
        assert sum(weight.values()) == pytest.approx(1, abs=1e-4)
        for t in range(n):
            assert [sum(w for y, w in weight.items() if y[t] == k) for k in range(5)] == pytest.approx(p[r, t].tolist(), abs=1e-4)
        best = max(weight, key=weight.get)
        spans = [(int(y) // 2, a, next((b for b in range(a + 1, n) if best[b] != y + 1), n)) for a, y in enumerate(best) if y % 2]
        assert [s[:3] for s in tagger.decode([x[r, :n]])[0]] == spans


def test_windows_and_reconciling():
    text = "x" * 500 + "12@" + "y" * 40 + "5" * 700 + "z" * 100 + "@" + "q" * 30
    cut = list(P.stretches(text))
    assert cut == [(476, 500 + 3 + 40 + 700 + P.REACH), (len(text) - 31 - P.REACH, len(text) - 30 + P.REACH)]
    for s, e in cut:
        w = list(P.windows(s, e))
        assert w[0][0] == s and w[-1][1] == e and all(a[1] - b[0] == P.OVERLAP for a, b in zip(w, w[1:])) and all(b - a <= P.WINDOW for a, b in w)
    assert list(P.stretches("no digit")) == [] and list(P.stretches("")) == []
    # Cut by the first window's end, found from its start in the second: one span; of differing spans the one away from edges stays.
    assert P.reconciled([(0, 192, [(3, 150, 192, 0.9)]), (128, 320, [(3, 150, 200, 0.95)])]) == [(3, 150, 200, 0.9)]
    assert P.reconciled([(0, 192, [(1, 180, 190, 0.9)]), (128, 320, [(2, 178, 196, 0.8)])]) == [(2, 178, 196, 0.8)]
    assert P.reconciled([(0, 192, [(1, 100, 110, 0.9)]), (128, 320, [(1, 130, 140, 0.8)])]) == [(1, 100, 110, 0.9), (1, 130, 140, 0.8)]


@pytest.fixture(scope="module")
def tagger(spark):
    return P.fit_tagger(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), most_texts=1200)


def test_held_out_spellings(spark, tagger):
    """Things in texts that were not trained on, spelt so that no pattern takes them: most are found, harmless ones aren't."""
    rng = np.random.default_rng(77)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text and len(r.text) > 200 and not re.search("[0-9@]", r.text)]
    given = ("ab.12@mail7.example.com", "12.3.4.5", "4111111111111111", "+1 (523) 555-1055")
    rows, want = [], []
    for i in range(1000):
        text, kind = texts[i % len(texts)], i % 4
        at = int(rng.integers(40, len(text) - 60))
        for new, k in ((P._rewritten(kind, given[kind], rng), kind), (P._harmless(rng), None)):
            made = f"{text[:at]} {new} {text[at:]}"
            if not P.base_spans(made):
                rows.append(made)
                want.append(k if k is None else (k, at + 1, at + 1 + len(new)))
    got = P.Finder(tagger, 0.9).found(rows)
    hidden = [(w, g) for w, g in zip(want, got, strict=True) if w]
    assert len(hidden) > 200 and sum(any(s[:3] == w for s in g) for w, g in hidden) >= 0.8 * len(hidden)
    clean = [g for w, g in zip(want, got, strict=True) if w is None]
    assert sum(map(bool, clean)) <= 0.01 * len(clean)
    # A text's spans don't depend on what is tagged beside it.
    assert [P.Finder(tagger, 0.9).found([r])[0] for r in rows[:40]] == [[(*s[:4], pytest.approx(s[4], abs=1e-3)) for s in g] for g in got[:40]]


def test_cases(spark, tagger):
    secret = "Call (743) 555-3824 or write to hsr.29@mail5.example.com from 42.144.35.254 with 4111111111111111. "
    rows = [(1, None, 1), (2, "", 2), (3, "nothing here", 3), (4, secret, 4), (4, secret, 4), (None, secret, 5), (6, "é中😀 " + secret, 6), (7, secret * 3000, 7), (8, "7" * 20_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    got = {}
    for r in P.find_personal(docs, tagger).collect():
        got.setdefault(r.doc_id, []).append([(s.kind, s.start, s.end) for s in r.spans if s.base])
        text = dict((x[0], x[1]) for x in rows)[r.doc_id] or ""
        assert [tuple(s)[:3] for s in r.spans] == sorted(tuple(s)[:3] for s in r.spans)
        assert got[r.doc_id][-1] == plain_spans(text)
    assert len(got[4]) == 2 and len(got[7][0]) == 9000 and got[1] == got[2] == got[3] == got[8] == [[]]
    assert P.find_personal(docs.limit(0), tagger).count() == 0
    assert P.fit_tagger(docs.limit(0)) is None and P.fit_tagger(docs.filter("doc_id = 3")) is None
    hidden = P.masked(docs, tagger).filter("doc_id = 6").first()
    assert hidden.spans == 6 and "hsr" not in hidden.text and "42.144" not in hidden.text and "[email]" in hidden.text
    assert P.masked(docs, None).filter("doc_id = 1").first().text is None


def test_query(spark):
    from tessera.llm import queries

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op12_personal_data(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in base) for k in range(4))
        words = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(words).encode()).hexdigest()
        assert set(words) <= set(r.spans.split(","))


def test_symbols():
    assert symbols("aé1٣  中😀").tolist() == [97, 128, 49, 129, 32, 130, 128, 131]
