"""Quality: a linear-chain conditional random field over the lines of a text.

Each line is good or bad.  Its features are its own and those of the lines
before and after it; forward-backward marginals, weighted by the lines' lengths,
add up to the share of good text, from which a logistic curve gives the
document's score.

Labels exist for documents only.  A first field learns from lines that carry
their document's label.  In bad documents the lines that it finds good, but
never the worst one, are then relabelled, and the field is learnt again.  The
sample is bounded by two parameters: ``most`` documents, and of these, in the
order of a hash, whole documents until they have ``most_lines`` lines.

Cases.  Null or empty text is one empty line.  Very long lines and texts need
memory in proportion to their length.  Without labels of both kinds all scores
are the share of good labels.  Repeated rows are scored alike.  Only doc_id and
text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._fit import labelled_sample, logistic, sigmoid
from tessera.llm._store import Scratch, bound_batches, lean, spread

SAMPLE = 6_000
SAMPLE_LINES = 400_000
BATCH = 256

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_LOUD = b"!?"
_ODD = b"%&$#*~^|<>{}[]\\=+_@"
_BAR = b"|"
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
OWN = 14
SHOWN = (1, 2, 3, 4, 5, 6, 7, 8)  # own features that both neighbours show as well
WIDTH = OWN + 2 * len(SHOWN)


def _squeezed(x: float) -> float:
    return np.log1p(20.0 * x) / 3.0


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines, WIDTH) features and the lines' lengths, their breaks included."""
    lines = text.split(b"\n")
    seen = Counter(lines)
    own = np.zeros((len(lines), OWN), np.float32)
    for i, line in enumerate(lines):
        n = len(line)
        own[i, 0] = 1.0
        if not n:
            own[i, 11] = 1.0
            continue
        words = line.split()
        w = len(words) or 1
        share = lambda chars: (n - len(line.translate(None, chars))) / n
        own[i, 1] = share(_ODD)
        own[i, 2] = share(_LOUD)
        own[i, 3] = (n - len(line.translate(None, _UPPER))) / max(1, n - len(line.translate(None, _LETTERS)))
        own[i, 4] = share(_DIGITS)
        own[i, 5] = share(_BAR)
        own[i, 6] = 1.0 - len(set(words)) / w
        own[i, 7] = sum(map(eq, words, words[1:])) / w
        own[i, 8] = 1.0 if seen[line] > 1 else 0.0
        own[i, 9] = n / w / 10.0
        own[i, 10] = np.log1p(n) / 8.0
        own[i, 12] = 1.0 if line[-1:] in b".!?\"" else 0.0
        own[i, 13] = 1.0 if w < 4 else 0.0
    own[:, 1:8] = _squeezed(own[:, 1:8])
    around = np.zeros((len(lines) + 2, len(SHOWN)), np.float32)
    around[1:-1] = own[:, list(SHOWN)]
    lengths = np.array([len(x) + 1 for x in lines], float)
    return np.concatenate([own, around[:-2], around[2:]], 1), lengths


class Field:
    """States 0 (bad) and 1 (good); ``w`` scores good against bad, ``t[a, b]`` the step from a to b."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    def padded(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For documents padded to one length, x (docs, lines, WIDTH): P(good) of each line, P(a, b) of each step."""
        docs, size = x.shape[:2]
        here = np.stack([np.zeros((docs, size)), np.clip(x @ self.w, -30, 30)], -1)
        step = np.exp(self.t)
        emit = np.exp(here - here.max(-1, keepdims=True))
        inside = np.arange(size)[None, :] < n[:, None]
        alpha, beta = np.empty_like(emit), np.ones_like(emit)
        a = emit[:, 0] / emit[:, 0].sum(-1, keepdims=True)
        alpha[:, 0] = a
        for i in range(1, size):
            a = (a @ step) * emit[:, i]
            a /= a.sum(-1, keepdims=True)
            alpha[:, i] = a
        b = np.ones((docs, 2))
        for i in range(size - 2, -1, -1):
            new = (emit[:, i + 1] * b) @ step.T
            new /= new.sum(-1, keepdims=True)
            b = np.where(inside[:, i + 1, None], new, 1.0)
            beta[:, i] = b
        good = alpha * beta
        good = good[..., 1] / good.sum(-1)
        pair = alpha[:, :-1, :, None] * step[None, None] * (emit * beta)[:, 1:, None, :]
        pair /= np.maximum(pair.sum((-1, -2), keepdims=True), 1e-300)
        return np.where(inside, good, 0.0), pair * inside[:, 1:, None, None]

    def marginals(self, features: Sequence[np.ndarray]) -> list[np.ndarray]:
        """P(good) of every line of every document."""
        out: list[np.ndarray] = [np.empty(0)] * len(features)
        for group in _groups([len(f) for f in features]):
            x, n = _pad([features[i] for i in group])
            for i, p in zip(group, self.padded(x, n)[0], strict=True):
                out[i] = p[: len(features[i])]
        return out


def _groups(sizes: Sequence[int], cells: int = 1 << 16) -> Iterator[list[int]]:
    """Documents of like length together, so that padding at most doubles them."""
    group: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if group and (sizes[i] > 2 * sizes[group[0]] or (len(group) + 1) * sizes[i] > cells):
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _pad(features: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(f) for f in features])
    x = np.zeros((len(features), n.max(), WIDTH), features[0].dtype)
    for i, f in enumerate(features):
        x[i, : len(f)] = f
    return x, n


def fit_field(features: Sequence[np.ndarray], lines: Sequence[np.ndarray], steps: int = 120, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam, with all groups in every step."""
    groups = []
    for group in _groups([len(f) for f in features]):
        x, n = _pad([features[i] for i in group])
        y = np.zeros(x.shape[:2], np.int8)
        for k, i in enumerate(group):
            y[k, : n[k]] = lines[i]
        inside = np.arange(x.shape[1])[None, :] < n[:, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
        groups.append((x, n, y * inside, inside, seen))
    total = sum(len(f) for f in features)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for k in range(1, steps + 1):
        field = Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
        slope = -ridge * theta
        for x, n, y, inside, seen in groups:
            good, pair = field.padded(x, n)
            slope[:WIDTH] += np.einsum("dl,dlf->f", (y - good) * inside, x) / total
            slope[WIDTH:] += (seen - pair.sum((0, 1))).ravel() / total
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * (1 - k / (steps + 20))
    return Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


@dataclass(frozen=True)
class QualityModel:
    w: tuple[float, ...]
    t: tuple[tuple[float, float], tuple[float, float]]
    curve: tuple[float, float, float]

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        made = [line_features(t) for t in texts]
        field = Field(np.array(self.w), np.array(self.t))
        shares = _shares(field, [f for f, _ in made], [n for _, n in made])
        return sigmoid(self.curve[0] + shares @ np.array(self.curve[1:]))


def _shares(field: Field, features: Sequence[np.ndarray], lengths: Sequence[np.ndarray]) -> np.ndarray:
    """Of each document: the length-weighted mean of the marginals, as log odds and as it is."""
    mean = np.array([float((p * n).sum() / n.sum()) for p, n in zip(field.marginals(features), lengths, strict=True)])
    near = np.clip(mean, 1e-3, 1 - 1e-3)
    return np.stack([np.log(near / (1 - near)), mean], -1) if len(mean) else np.zeros((0, 2))


def _bounded(sample: DataFrame, scratch: Scratch, most_lines: int) -> DataFrame:
    """Whole texts in the order of a hash, up to the one that reaches ``most_lines`` lines; only numbers are ordered."""
    sample = scratch.cut(sample.withColumn("n", F.regexp_count("text", F.lit("\n")) + 1).withColumn("row", F.monotonically_increasing_id()))
    if (sample.agg(F.sum("n")).first()[0] or 0) <= most_lines:
        return sample
    before = F.sum("n").over(Window.orderBy(F.xxhash64("row", F.lit(5)), "row").rowsBetween(Window.unboundedPreceding, -1))
    chosen = sample.select("row", "n").withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most_lines)
    return sample.join(F.broadcast(chosen.select("row")), "row")


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most: int = SAMPLE, most_lines: int = SAMPLE_LINES) -> QualityModel:
    bound_batches(docs.sparkSession)
    sample = _bounded(labelled_sample(docs, labels, label, usable, most), Scratch(docs.sparkSession, "quality"), most_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            made = [line_features(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f, _ in made], pa.binary()), pa.array([n.tobytes() for _, n in made], pa.binary()), batch.column(1)], names=["features", "lengths", "y"])

    rows = sample.select("text", "y").mapInArrow(run, "features binary, lengths binary, y int").toArrow()
    features = [np.frombuffer(f.as_buffer(), np.float32).reshape(-1, WIDTH) for f in rows.column("features")]
    lengths = [np.frombuffer(n.as_buffer(), float) for n in rows.column("lengths")]
    y = rows.column("y").to_numpy().astype(int)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return QualityModel((0.0,) * WIDTH, ((0.0, 0.0), (0.0, 0.0)), (float(np.log(share / (1 - share))), 0.0, 0.0))
    lines = [np.full(len(f), v, np.int8) for f, v in zip(features, y, strict=True)]
    field = fit_field(features, lines)
    for i, p in enumerate(field.marginals(features)):
        if not y[i]:
            lines[i] = (p > 0.5).astype(np.int8)
            lines[i][np.argmin(p)] = 0
    field = fit_field(features, lines)
    curve = logistic(_shares(field, features, lengths), y)
    return QualityModel(tuple(map(float, field.w)), tuple(tuple(map(float, r)) for r in field.t), tuple(map(float, curve)))


def score_quality(docs: DataFrame, model: QualityModel, least: float = 0.7) -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                scores = model.scores([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    bound_batches(docs.sparkSession)
    return spread(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
