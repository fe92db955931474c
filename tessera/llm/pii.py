"""Personal data: patterns, and spans that a character-level BiLSTM-CRF adds.

Kinds are email, ip, card and phone.  The patterns' spans are the base; they
are always returned.  The tagger is trained here, in numpy, from spans that the
patterns label in a bounded sample of windows (a documented parameter), from
the same windows with a span written another way (``_rewritten``), and from
windows without spans.  It finds what the patterns' spelling rules miss: phone
numbers without a plus, addresses with blanks or brackets about their dots,
cards grouped by other marks.

Texts are read whole.  Every kind needs a digit or an @, so the tagger reads the
stretches around these with ``REACH`` code points on both sides; the rest can
hold no span.  Stretches are cut into windows of ``WINDOW`` that overlap by
``OVERLAP``; each is decoded, and then spans are reconciled over the stretch:
parts that a window's edge cut are joined with the overlapping part of the next
window, of spans that differ the one farther from its window's edges stays.
An added span has a confidence of ``least`` or more, passes the same rule as its kind's
base spans (digits, parts, Luhn) and overlaps no base span.

Cases.  Null and empty texts have no spans.  Repeated rows are judged each by
itself.  Very long texts are read window by window; what is kept of them is the
text and its spans.  Without labelled spans (an empty table, or none that
matches) only base spans are found.  Other columns of the input are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import bound_batches, lean, spread
from tessera.llm._tagger import Tagger, symbols

KINDS = ("email", "ip", "card", "phone")
REACH, WINDOW, OVERLAP = 24, 192, 64
AT_ONCE = 1024  # windows tagged at a time
SPANS = "array<struct<kind:int,start:int,end:int,base:boolean,confidence:double>>"

_DIGIT = re.compile("[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile("[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NAMED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_STRETCH = re.compile(f"[0-9@]++(?:[^0-9@]{{0,{2 * REACH}}}+[0-9@]++)*+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def valid(kind: int, text: str) -> bool:
    """The rule of a kind on its digits, or on an address's parts, however they are spelt."""
    if kind == 0:
        return "@" in text and bool(re.search(r"[A-Za-z0-9].*@.*[A-Za-z0-9]", text, re.S))
    parts = re.findall("[0-9]+", text)
    digits = "".join(parts)
    if kind == 1:
        return len(parts) == 4 and all(map(_small, parts))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' spans, by kind, then start."""
    found: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAMED:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            done = host.end()
            found.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    for chain in _CHAIN.finditer(text):
        if chain.group().count(".") >= 3:
            place, parts = chain.start(), chain.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                end = place + sum(map(len, parts[i : i + 4])) + 3
                if all(map(_small, parts[i : i + 4])):
                    found.append((1, place, end))
                place = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and valid(2, m.group()):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if valid(3, m.group()):
            found.append((3, m.start(), m.end()))
    return found


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Where the tagger looks: each digit or @ with its surroundings."""
    for m in _STRETCH.finditer(text):
        yield max(0, m.start() - REACH), min(len(text), m.end() + REACH)


def windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Of one stretch; each shares ``OVERLAP`` with the next."""
    while end - start > WINDOW:
        yield start, start + WINDOW
        start += WINDOW - OVERLAP
    yield start, end


def reconciled(found: list[tuple[int, int, list[tuple[int, int, int, float]]]]) -> list[tuple[int, int, int, float]]:
    """Spans of one stretch from those of its windows (start, end, spans with places in the text), in order."""
    joined: list[list] = []  # kind, start, end, confidence, distance from the edges that were cut
    first, last = found[0][0], found[-1][1]
    for a, b, spans in found:
        for kind, s, e, sure in spans:
            room = min(s - a if a > first else WINDOW, b - e if b < last else WINDOW)
            cut_left = s == a and a > first
            cut_last = joined and joined[-1][5]
            if joined and joined[-1][0] == kind and joined[-1][2] > s and (cut_left or cut_last):
                other = joined[-1]
                other[1:4] = min(other[1], s), max(other[2], e), min(other[3], sure)
                other[4], other[5] = max(other[4], room), e == b and b < last
            else:
                joined.append([kind, s, e, sure, room, e == b and b < last])
    kept: list[list] = []
    for span in sorted(joined, key=lambda x: (x[1], x[0], x[2])):
        if kept and span[1] < kept[-1][2]:
            if (span[4], span[3]) <= (kept[-1][4], kept[-1][3]):
                continue
            kept.pop()
        kept.append(span)
    return [tuple(span[:4]) for span in kept]


# ---- training ----


def _rewritten(kind: int, text: str, rng: np.random.Generator) -> str:
    """The same kind of thing, with other digits and letters, and often in a spelling that no pattern takes."""
    if kind == 2:  # any digits whose last one makes them valid
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        digits += next(d for d in "0123456789" if luhn(digits + d))
        mark = rng.choice(["", " ", "-", ".", " - ", " ", "/"])
        return mark.join(digits[i : i + 4] for i in range(0, 16, 4))
    other = "".join(str(rng.integers(0, 10)) if c.isdigit() else chr(97 + rng.integers(0, 26)) if c.isalpha() and kind != 0 else c for c in text)
    if kind == 1:
        mark = rng.choice([".", "[.]", " . ", "(.)", ". "])
        return mark.join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 0:
        name, _, host = other.partition("@")
        way = rng.integers(0, 5)
        if way == 0:
            return f"{name} @ {host}"
        if way == 1:
            return f"{name}@{host.replace('.', '[.]')}"
        if way == 2:
            return f"{name}@{host.replace('.', ' . ')}"
        return f"{name}[@]{host}" if way == 3 else other
    digits = [c for c in other if c.isdigit()][-10:]
    if len(digits) < 10:
        return other
    a, b, c = "".join(digits[:3]), "".join(digits[3:6]), "".join(digits[6:])
    return str(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1 ({a}) {b}-{c}", f"+1/{a}/{b}/{c}", other]))


def _harmless(rng: np.random.Generator) -> str:
    """Digits and @ that are nobody's data."""
    r = lambda a, b: int(rng.integers(a, b))
    hexed = "".join(rng.choice(list("0123456789abcdef"), r(12, 41)))
    return str(rng.choice([f"{r(1900, 2100)}-{r(1, 13):02}-{r(1, 29):02}", f"{r(1, 10)}.{r(0, 30)}.{r(0, 99)}", f"{r(0, 24):02}:{r(0, 60):02}", f"{r(1, 10**6)}", f"{r(1, 10**4)}.{r(0, 100):02}", f"#{r(1, 10**8)}", f"password={hexed}", f'token = "{hexed}"', f"{r(1, 100)} %", f"@{hexed[:6]}", f"[{r(1, 99)}]", f"{r(10**8, 10**9)}{r(10**5, 10**6)}", f"{r(256, 999)}.{r(256, 999)}.{r(256, 999)}.{r(256, 999)}", hexed]))


def _tags(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in sorted(spans, key=lambda s: s[2] - s[1]):  # where spans overlap, the longer is right
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    inside = (out > 0) & (out % 2 == 0)
    broken = inside & ~np.concatenate([[False], np.isin(out[:-1] - out[1:], (0, -1)) & (out[:-1] > 0)])
    out[broken] = 0
    return out


def examples(sample: list[tuple[str, list[tuple[int, int, int]]]], variants: int = 3, seed: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """Symbols and tags of the sampled windows, of rewritten ones, and of ones whose span is replaced by something harmless."""
    rng = np.random.default_rng(seed)
    rows = []
    for text, spans in sample:
        rows.append((symbols(text), _tags(len(text), spans)))
        whole = [s for s in spans if s[1] > 0 and s[2] < len(text)]
        if not whole:
            continue
        kind, a, b = whole[int(rng.integers(0, len(whole)))]
        before, after = text[max(0, a - 40) : a], text[b : b + 40]
        if base_spans(before) or base_spans(after):
            continue
        for _ in range(variants * (1 if kind < 2 else 2)):  # cards and phones have more spellings
            new = _rewritten(kind, text[a:b], rng)
            rows.append((symbols(before + new + after), _tags(len(before + new + after), [(kind, len(before), len(before) + len(new))])))
        for _ in range(2):
            new = before + _harmless(rng) + after
            rows.append((symbols(new), _tags(len(new), base_spans(new))))
    return [r for r in rows if len(r[0])]


def _sampled(each: int):
    """(text, kinds, starts, ends): of each text ``each`` windows at most for training, those with the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        import xxhash

        for batch in lean(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                cut = (w for s in stretches(text) for w in windows(*s))
                for a, b in heapq.nsmallest(each, cut, key=lambda w: (xxhash.xxh3_64_intdigest(text[w[0] : w[1]].encode()), w)):
                    mine = [(k, max(s, a) - a, min(e, b) - a) for k, s, e in base if s < b and e > a]
                    rows.append((text[a:b], *([list(x) for x in zip(*mine, strict=True)] or ([], [], []))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.list_(pa.int32())) for i in range(4)], names=["text", "kinds", "starts", "ends"])

    return run


def fit_tagger(docs: DataFrame, most_texts: int = 1200, each: int = 3, **how) -> Tagger | None:
    """Trained on windows of about ``most_texts`` texts, drawn by a hash of the text among those with a digit or an @, and ``each`` windows of a text at most."""
    bound_batches(docs.sparkSession)
    able = docs.select("text").filter(F.col("text").rlike("[0-9@]"))
    total = able.count()
    if total > most_texts:
        parts = 1 << 30
        able = able.filter(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(parts)) < int(parts * most_texts / total))
    found = able.distinct().mapInArrow(_sampled(each), "text string, kinds array<int>, starts array<int>, ends array<int>").collect()
    sample = sorted((r.text, list(zip(r.kinds, r.starts, r.ends, strict=True))) for r in found)
    if not any(spans for _, spans in sample):
        return None
    return Tagger(len(KINDS)).fit(examples(sample), **how)


# ---- finding ----


class Finder:
    """Spans of texts, many windows at a time."""

    def __init__(self, tagger: Tagger | None, least: float):
        self.tagger, self.least = tagger, least

    def found(self, texts: list[str]) -> list[list[tuple[int, int, int, bool, float]]]:
        out = [[(k, a, b, True, 1.0) for k, a, b in base_spans(t)] for t in texts]
        if self.tagger is None:
            return out
        held: list[tuple[int, int, int]] = []  # text, stretch's start and end
        count = 0
        for i, t in enumerate(texts):
            for s in stretches(t):
                held.append((i, *s))
                count += (s[1] - s[0]) // (WINDOW - OVERLAP) + 1
                if count >= AT_ONCE:
                    self._tagged(texts, held, out)
                    held, count = [], 0
        self._tagged(texts, held, out)
        return out

    def _tagged(self, texts, held, out) -> None:
        cut = [(n, a, b) for n, (_, s, e) in enumerate(held) for a, b in windows(s, e)]
        spans: list = [None] * len(cut)
        order = sorted(range(len(cut)), key=lambda w: (cut[w][2] - cut[w][1], w))
        for first in range(0, len(order), 128):
            mine = order[first : first + 128]
            rows = [symbols(texts[held[cut[w][0]][0]][cut[w][1] : cut[w][2]]) for w in mine]
            for w, got in zip(mine, self.tagger.decode(rows), strict=True):
                spans[w] = [(k, cut[w][1] + a, cut[w][1] + b, sure) for k, a, b, sure in got]
        first = 0
        while first < len(cut):
            last = first
            while last < len(cut) and cut[last][0] == cut[first][0]:
                last += 1
            i = held[cut[first][0]][0]
            text = texts[i]
            for kind, a, b, sure in reconciled([(cut[w][1], cut[w][2], spans[w]) for w in range(first, last)]):
                if sure >= self.least and valid(kind, text[a:b]):
                    out[i].append((kind, a, b, False, sure))
            first = last


def _apart(spans: list[tuple[int, int, int, bool, float]]) -> list[tuple[int, int, int, bool, float]]:
    """Without added spans that overlap base ones; by kind, then start."""
    base = sorted((a, b) for _, a, b, is_base, _ in spans if is_base)
    starts, ends = np.array([a for a, _ in base]), np.maximum.accumulate([b for _, b in base]) if base else np.zeros(0)
    free = lambda a, b: (k := int(np.searchsorted(starts, b))) == 0 or ends[k - 1] <= a
    return sorted((s for s in spans if s[3] or free(s[1], s[2])), key=lambda s: (s[0], s[1], s[2]))


def _finds(tagger: Tagger | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(tagger, least)
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("confidence", pa.float64())]))
        names = ("kind", "start", "end", "base", "confidence")
        for batch in lean(batches):
            found = finder.found([t or "" for t in batch.column(1).to_pylist()])
            rows = [[dict(zip(names, s, strict=True)) for s in _apart(spans)] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return run


def find_personal(docs: DataFrame, tagger: Tagger | None, least: float = 0.9) -> DataFrame:
    """doc_id and spans of each row: kind (its place in ``KINDS``), start and end in code points, base, confidence; by kind, then start."""
    bound_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", "text")).mapInArrow(_finds(tagger, least), f"doc_id {id_type}, spans {SPANS}")


def listed(spans: str | Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(docs: DataFrame, tagger: Tagger | None, least: float = 0.9) -> DataFrame:
    """The rows of ``docs`` with each span of the text replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(tagger, least)
        for batch in lean(batches):
            texts = batch.column(at).to_pylist()
            new = []
            for text, spans in zip(texts, finder.found([t or "" for t in texts]), strict=True):
                made, done = [], 0
                for kind, a, b, *_ in sorted(_apart(spans), key=lambda s: (s[1], s[0])):
                    if a >= done:
                        made += [text[done:a], f"[{KINDS[kind]}]"]
                    done = max(done, b)
                new.append(text if text is None else "".join([*made, text[done:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
