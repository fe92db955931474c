"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded: lower case, homoglyphs of other scripts and full width forms
to Latin letters, digits and signs that stand for letters to those letters (i,
l, 1 and | are one letter here), everything else that is no letter to a blank.
Lexicon entries are whole words, or beginnings of words that go on, with a
weight; a match inside an exception phrase doesn't count.  The weights of a text's matches,
alone and normalised by its number of words, give a score by a logistic curve.

Entries and weights are learnt from labelled documents: the log odds of a word
or beginning of a word in toxic against other documents.  The sample is bounded
by ``most`` rows; counting and testing run on the executors, and what passes the
test is the lexicon, however much that is.

Cases.  Null, empty and blank texts have no match and get the curve's lowest
value.  Repeated rows are scored alike; equal texts with different labels count
as toxic once.  Without labels a seed lexicon of fixed values is used.  A very
long text is matched whole, in one pass over its characters.  An empty table
gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._fit import labelled_sample, logistic, sigmoid
from tessera.llm._store import Scratch, bound_batches, lean, spread

# What stands for which letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ӏ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}  # only between two letters or digits
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "circus clown", "clown fish", "pond scum", "sore loser rule")

PREFIXES = range(3, 9)
SAMPLE = 10_000

_BETWEEN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])").sub


def _table() -> dict[int, str]:
    table = {c: " " for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0xAA), 0xAB, 0xBB, 0xBF]}
    table |= {c: " " for c in [*range(0x2000, 0x2070), *range(0x3000, 0x3004), 0x1680]}
    for c in range(26):
        low = "i" if chr(97 + c) == "l" else chr(97 + c)
        table |= {65 + c: low, 97 + c: low, 0xFF21 + c: low, 0xFF41 + c: low}
    for a, b in (HOMOGLYPHS | SUBSTITUTES).items():
        table[ord(a)] = b
        if len(a.upper()) == 1:
            table[ord(a.upper())] = b
    table |= {c: "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    return table


_FOLD = str.maketrans(_table())


def fold(text: str) -> str:
    """Folded words, one blank at least between them and at both ends."""
    if any(s in text for s in SIGNS):
        text = _BETWEEN(lambda m: SIGNS[m.group()], text)
    text = text.translate(_FOLD)
    return f" {text if text.isascii() else text.lower()} "


@dataclass(frozen=True)
class Lexicon:
    """Entries: " word " or " begin" with their weights; exceptions: " some words "; curve: constant, log weight, log density."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = tuple(fold(e) for e in EXCEPTIONS)
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.entries:
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def weigh(self, text: str) -> tuple[float, int, int]:
        """Weight of the matches outside exceptions, their number, number of words."""
        folded = fold(text)
        words = len(folded.split())
        if not len(self.automaton):
            return 0.0, 0, words
        hits, spared = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            if folded[end] != " " and folded[end + 1] == " ":
                continue  # the word doesn't go on
            (spared if weight is None else hits).append((end - size + 1, end, weight or 0.0))
        if spared and hits:
            spared.sort()
            begins, reach = [a for a, *_ in spared], list(accumulate((b for _, b, _ in spared), max))
            hits = [h for h in hits if h[0] < begins[0] or reach[bisect_right(begins, h[0]) - 1] < h[1]]
        return sum(h[2] for h in hits), len(hits), words

    @staticmethod
    def features(weight, words):
        return np.log1p(np.stack([weight, 100.0 * np.asarray(weight) / (np.asarray(words) + 20.0)], -1))

    def score(self, text: str) -> tuple[float, int, int]:
        weight, hits, words = self.weigh(text)
        a, b, c = self.lexicon.curve
        return float(sigmoid(a + b * math.log1p(weight) + c * math.log1p(100.0 * weight / (words + 20.0)))), hits, words


def _features_of(text: str) -> set[str]:
    """A text's words, and the beginnings of its words."""
    words = set(fold(text).split())
    found = {f" {w} " for w in words}
    for n in PREFIXES:
        found.update(" " + w[:n] for w in words if len(w) > n)
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) to the features' document frequencies in each batch: t in toxic, c in other documents."""
    for batch in lean(batches):
        counts: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[y == 1].update(_features_of(text))
        other, toxic = counts
        names = list(other.keys() | toxic.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([other[f] for f in names], pa.int64())], names=["feature", "t", "c"])


def tested(counts: DataFrame, toxic: int, other: int, features: int, least_odds: float = 2.5) -> DataFrame:
    """(feature, t, c) to (feature, odds, ratio) of those that tell toxic texts.

    Their log-likelihood ratio must be larger than chance gives for the best of ``features``.
    """
    t, c = F.col("t"), F.col("c")
    share = (t + c) / F.lit(float(toxic + other))
    odds = F.log((t + 0.5) / F.lit(toxic + 1.0)) - F.log((c + 0.5) / F.lit(other + 1.0))
    ratio = t * F.log(t / (share * float(toxic))) + F.when(c > 0, c * F.log(c / (share * float(other)))).otherwise(0.0)
    least = max(4, math.ceil(toxic / 150))
    return counts.filter(t >= least).select("feature", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("odds") >= least_odds) & (F.col("ratio") > math.log(features + 1)))


def select_entries(found: Iterable[tuple[str, float, float]]) -> list[tuple[str, float]]:
    """(feature, odds, ratio) to entries that don't overlap, the best first."""
    chosen: list[tuple[str, float]] = []
    taken: set[str] = set()
    inner: set[str] = set()
    for _, _, feature, odds in sorted(((ratio, len(feature), feature, odds) for feature, odds, ratio in found), reverse=True):
        heads = {feature[:n] for n in range(2, len(feature) + 1)}
        if feature in inner or heads & taken:
            continue  # a beginning of an entry, or begun by one
        chosen.append((feature, round(odds, 4)))
        taken.add(feature)
        inner |= heads
    return chosen


def fit_lexicon(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = SAMPLE) -> Lexicon:
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.cut(labelled_sample(docs, labels, label, usable, most).groupBy("text").agg(F.max("y").alias("y")))
    sizes = dict(sample.groupBy("y").count().collect())
    toxic, other = sizes.get(1, 0), sum(n for y, n in sizes.items() if y != 1)
    seeds = tuple((fold(w), 3.0) for w in SEED_WORDS)
    if not toxic or not other:
        return Lexicon(seeds)
    counts = sample.mapInArrow(_counted, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = scratch.cut(counts.filter("t > 0"))
    entries = select_entries(tuple(r) for r in tested(counts, toxic, other, counts.count()).collect())
    has = {e for e, _ in entries}
    lexicon = Lexicon(tuple(entries) + tuple(s for s in seeds if not any(s[0][:n] in has for n in range(2, len(s[0]) + 1))))
    weighed = np.array([tuple(r) for r in sample.mapInArrow(_weighed(lexicon), "weight double, words bigint, y int").collect()], float)
    curve = logistic(Matcher.features(weighed[:, 0], weighed[:, 1]), weighed[:, 2])
    return Lexicon(lexicon.entries, lexicon.exceptions, tuple(map(float, curve)))


def _weighed(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in lean(batches):
            rows = [matcher.weigh(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), batch.column(1)], names=["weight", "words", "y"])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """doc_id, row_key (xxhash64 of the text), score, predicted, hits, n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in lean(batches):
            rows = [matcher.score(t or "") for t in batch.column(2).to_pylist()]
            columns = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int64(), pa.int64())))], names=["doc_id", "row_key", "score", "hits", "n_words"])

    bound_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, score double, hits bigint, n_words bigint"
    found = spread(docs).select("doc_id", F.xxhash64("text").alias("row_key"), "text").mapInArrow(run, schema)
    return found.select("doc_id", "row_key", "score", (F.col("score") >= least).cast("int").alias("predicted"), "hits", "n_words")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, columns unchanged."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in lean(batches):
            yield batch.filter(pa.array([matcher.score(t or "")[0] < least for t in batch.column(at).to_pylist()], pa.bool_()))

    bound_batches(docs.sparkSession)
    return spread(docs).mapInArrow(run, docs.schema)
