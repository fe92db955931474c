"""Media columns: chroma audio fingerprints and the alignment of recordings.

A recording is cut into overlapping frames; each frame's spectrum is folded
into 12 pitch classes.  Sixteen filters are laid over the image of pitch class
by time; each compares sums of rectangles, read off the integral image, and
gives two bits, so every frame has a 32-bit integer.  Two recordings are
aligned by the histogram of the offsets at which their integers agree; every
offset with enough votes is tested.  Bit errors of the overlap tell how good the
match is; where they are too many, those of the segment that matches best do, so
a clip that two different recordings share is found, behind whole matches.

An integer that is frequent in both recordings, such as that of silence, would
meet itself all with all.  Its votes are counted by a convolution (a fast
Fourier transform of where it stands) instead of one by one, so the histogram
is the same, and its cost stays below the square of the duration.

``decode`` turns the values of a column into samples: 16-bit PCM bytes, WAV
files, or what the caller passes in.  Recordings with one and the same
fingerprint are one class in the search, of which the k + 1 smallest keys are
kept, as no query can have more of them.  Queries lie in tiles (``operators.tiles``), and
every task returns at most k + 1 classes a query.

Cases.  An integer needs SPAN frames.  Null or empty media, and recordings
shorter than ``FRAME + (SPAN - 1) * HOP`` samples, have no fingerprint and match
nothing, copies neither.  Recordings of fewer integers than ``least_votes``, or
pairs with one such, must agree in all integers of the shorter one.  Ties go to
the smaller key.  Rows with a null in their key are queries, but match no one
and are matched by no one.  Rows of a repeated key are queries of their own.
Long recordings are transformed a block of frames at a time.  An empty table
gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._store import Scratch, bound_batches, lean, spread
from tessera.operators import tiles as _tiles

RATE, FRAME, HOP = 4000, 512, 256
CLASSES = 12
FRAMES = 1 << 19  # integers of a tile's queries
HEAVY = 1 << 16  # equal pairs of one integer that are counted by convolution
PAIRS = 1 << 20  # equal pairs held at once
BLOCK = 4096

#: Kind of rectangle comparison, first pitch class, height and width in frames.
FILTERS = tuple((i % 4, (5 * i) % CLASSES, 2 + i % 5, 3 + (i * 3) % 6) for i in range(16))
SPAN = max(w for *_, w in FILTERS)
STEPS = (-0.35, 0.0, 0.35)  # between the four values of a filter


def pcm16(value: bytes) -> np.ndarray:
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2").astype(np.float32) / 32768.0


def wav(value: bytes) -> np.ndarray:
    """Samples of a 16-bit WAV file, its channels averaged, at ``RATE`` by linear interpolation."""
    with wave.open(io.BytesIO(value)) as file:
        x = pcm16(file.readframes(file.getnframes())).reshape(-1, file.getnchannels()).mean(1)
        n = int(len(x) * RATE / file.getframerate())
        return np.interp(np.arange(n) * file.getframerate() / RATE, np.arange(len(x)), x).astype(np.float32)


def _pitch_map() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    to = np.zeros((len(hz), CLASSES), np.float32)
    for i, f in enumerate(hz):
        if 400 <= f <= 1900:
            place = (12 * np.log2(f / 440.0)) % CLASSES
            low = int(np.floor(place)) % CLASSES
            to[i, low] = 1 - (place % 1)
            to[i, (low + 1) % CLASSES] += place % 1
    return to


_PITCH = _pitch_map()
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12), each row scaled to sum 1; silent frames are flat."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, CLASSES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((n, CLASSES), np.float32)
    for a in range(0, n, BLOCK):
        power = np.abs(np.fft.rfft(frames[a : a + BLOCK] * _WINDOW, axis=1)).astype(np.float32) ** 2
        out[a : a + BLOCK] = power @ _PITCH
    total = out.sum(1, keepdims=True)
    return np.where(total > 1e-9, out / np.maximum(total, 1e-9), 1.0 / CLASSES)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each frame that has SPAN - 1 more behind it."""
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    tall = np.concatenate([image, image], 1)  # pitch classes go round
    whole = np.zeros((len(image) + 1, 2 * CLASSES + 1))
    whole[1:, 1:] = tall.cumsum(0, dtype=float).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return whole[t + t1, y1] - whole[t + t0, y1] - whole[t + t1, y0] + whole[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for i, (kind, y, h, w) in enumerate(FILTERS):
        half_h, half_w = max(1, h // 2), max(1, w // 2)
        if kind == 0:  # above against below
            a, b = area(0, w, y, y + half_h), area(0, w, y + half_h, y + 2 * half_h)
        elif kind == 1:  # before against after
            a, b = area(0, half_w, y, y + h), area(half_w, 2 * half_w, y, y + h)
        elif kind == 2:  # the diagonals
            a = area(0, half_w, y, y + half_h) + area(half_w, 2 * half_w, y + half_h, y + 2 * half_h)
            b = area(half_w, 2 * half_w, y, y + half_h) + area(0, half_w, y + half_h, y + 2 * half_h)
        else:  # a band against the rest of the octave
            a = area(0, w, y, y + h)
            b = (area(0, w, 0, CLASSES) - a) * (h / (CLASSES - h))
        level = np.searchsorted(STEPS, np.log((1e-2 + a) / (1e-2 + b)))
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * i)  # neighbours differ in one bit
    return out


def fingerprints(media: DataFrame, value_col: Column, decode: Callable[[object], np.ndarray] = pcm16, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The columns ``keys``, and frames array<int>; null for media without a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [None if v is None else fingerprint(chroma(decode(v))).view(np.int32) for v in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*keys, "frames"])

    bound_batches(media.sparkSession)
    rows = spread(media).select(*keys, value_col.alias("__value"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{schema}, frames array<int>")


class Aligner:
    """A block of query fingerprints against single recordings."""

    def __init__(self, queries: Sequence[np.ndarray], least_votes: int):
        self.queries, self.least = queries, least_votes
        self.size = np.array([len(q) for q in queries])
        values = np.concatenate(queries) if queries else np.zeros(0, np.int32)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.query = np.repeat(np.arange(len(queries)), self.size)[order]
        self.time = np.concatenate([np.arange(n) for n in self.size])[order] if queries else np.zeros(0, np.int64)

    def _votes(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query << 32 | offset + 2**31, ascending, and how many integers agree there."""
        values, back, mine = np.unique(frames, return_inverse=True, return_counts=True)
        a, b = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
        places, begin = np.argsort(back, kind="stable"), np.cumsum(mine) - mine
        found: list[tuple[np.ndarray, np.ndarray]] = []
        plain = np.flatnonzero((b > a) & ((b - a) * mine <= HEAVY))
        of, low, high = [plain], [a[plain]], [b[plain]]
        for i in np.flatnonzero((b - a) * mine > HEAVY).tolist():
            cut = a[i] + np.flatnonzero(np.diff(self.query[a[i] : b[i]], prepend=-1, append=-1))  # a range for each query
            many = np.diff(cut) * mine[i] > HEAVY
            for x, y in zip(cut[:-1][many], cut[1:][many]):
                found.append(self._convolved(places[begin[i] : begin[i] + mine[i]], slice(x, y), len(frames)))
            of.append(np.full(int((~many).sum()), i))
            low.append(cut[:-1][~many])
            high.append(cut[1:][~many])
        value, start, size = np.concatenate(of), np.concatenate(low), np.concatenate(high) - np.concatenate(low)
        to, k = np.cumsum(size * mine[value]), 0
        while k < len(value):  # so many ranges that their pairs stay few
            stop = max(k + 1, int(np.searchsorted(to, (to[k - 1] if k else 0) + PAIRS, "right")))
            v, n, m = value[k:stop], size[k:stop], mine[value[k:stop]]
            theirs = places[_steps(begin[v], m)]  # each range with each place of its value
            pairs = np.repeat(n, m)
            mine_at = _steps(np.repeat(start[k:stop], m), pairs)
            found.append(np.unique((self.query[mine_at].astype(np.int64) << 32) + (np.repeat(theirs, pairs) - self.time[mine_at] + (1 << 31)), return_counts=True))
            k = stop
        if len(found) < 2:
            return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        every, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        return every, np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)

    def _convolved(self, at: np.ndarray, where: slice, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For one query's places of an integer: its keys and votes, from the correlation of where it stands in both."""
        q = int(self.query[where][0])
        length = int(self.size[q])
        full = 1 << int(size + length - 1).bit_length()
        theirs, mine = np.zeros(full), np.zeros(full)
        theirs[at] = 1.0
        mine[length - 1 - self.time[where]] = 1.0
        votes = np.rint(np.fft.irfft(np.fft.rfft(theirs) * np.fft.rfft(mine), full)[: size + length - 1]).astype(np.int64)
        there = np.flatnonzero(votes > 0)
        return (q << 32) + (there - (length - 1) + (1 << 31)), votes[there]

    def align(self, frames: np.ndarray, most_errors: float) -> Iterator[tuple[int, int, int, float, bool]]:
        """(query, offset, votes, bit error, whether of a segment only): the best offset of every query with enough votes there.

        An integer that doesn't agree has a wrong bit at least, so the votes
        bound the errors from below, and offsets that can't be the best any
        more aren't tested.
        """
        keys, votes = self._votes(frames)
        if not len(keys):
            return
        need = np.minimum(np.minimum(self.least, len(frames)), self.size)[keys >> 32]
        full = votes >= need
        query, offset, votes, need = (keys >> 32)[full], ((keys & 0xFFFFFFFF) - (1 << 31))[full], votes[full], need[full]
        overlap = np.minimum(len(frames), offset + self.size[query]) - np.maximum(0, offset)
        floor = (overlap - votes) / (32.0 * overlap)
        order = np.lexsort((offset, -votes, floor, query))
        best: dict[int, tuple] = {}
        for q, d, vote, least, low in zip(*(x[order].tolist() for x in (query, offset, votes, need, floor))):
            if q in best and (False, low, -vote, d) >= best[q]:
                continue
            start, end = max(0, d), min(len(frames), d + int(self.size[q]))
            wrong = np.bitwise_count((frames[start:end] ^ self.queries[q][start - d : end - d]).view(np.uint32)).astype(np.int64)
            errors, clip = float(wrong.sum()) / (32.0 * len(wrong)), False
            if errors > most_errors:
                wrong = wrong[_segment(32 * most_errors - wrong)]
                vote, clip = int((wrong == 0).sum()), True
                if vote < least:
                    continue
                errors = float(wrong.sum()) / (32.0 * len(wrong))
            mine = (clip, errors, -vote, d)
            if q not in best or mine < best[q]:
                best[q] = mine
        for q, (clip, errors, vote, d) in best.items():
            yield q, d, -vote, errors, clip


def _steps(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on n[0] times, then from start[1], and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _segment(gain: np.ndarray) -> slice:
    """The run of values with the largest sum."""
    total = np.concatenate([[0.0], np.cumsum(gain)])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - lowest[:-1])) + 1
    return slice(int(np.argmin(total[:end])), end)


class _Tile:
    """A tile's queries against packs of classes of recordings: for each the best k classes."""

    def __init__(self, queries: pa.Table, k: int, least_votes: int, most_errors: float):
        self.k, self.most_errors = k, most_errors
        self.rows = queries.column("row").to_pylist()
        self.aligner = Aligner([x.values.to_numpy(zero_copy_only=False) for x in queries.column("frames")], least_votes)
        self.best: dict[int, list] = {}

    def offer(self, pack: pa.Table) -> None:
        for order, frames in zip(pack.column("class").to_pylist(), pack.column("frames"), strict=True):
            for q, offset, votes, errors, clip in self.aligner.align(frames.values.to_numpy(zero_copy_only=False), self.most_errors):
                if errors <= self.most_errors:
                    mine = self.best.setdefault(q, [])
                    mine.append((clip, errors, -votes, order, offset))
                    if len(mine) > 8 * self.k:
                        self.best[q] = sorted(mine)[: self.k]

    def found(self) -> pa.RecordBatch:
        rows = [(self.rows[q], order, offset, -votes, errors, clip) for q, mine in self.best.items() for clip, errors, votes, order, offset in sorted(mine)[: self.k]]
        columns = zip(*rows) if rows else ((),) * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "class", "shift", "votes", "bit_error", "clip"])


def align(queries: DataFrame, recordings: DataFrame, keys: Sequence[str] = ("id",), k: int = 1, least_votes: int = 4, most_errors: float = 0.25, own: bool = False, broadcast_bytes: int = _tiles.BROADCAST_BYTES) -> DataFrame:
    """``keys`` and frames on both sides.  The keys, n_frames, rank, match_<key>, shift, votes, bit_error, clip.

    At most k rows a query, whole matches first, then matched segments (``clip``),
    each of rising bit error; one row with nulls for a query that matches
    nothing.  ``shift``: frames by which the query starts later.  A recording of
    the query's own key is a match only if ``own``.
    """
    scratch = Scratch(recordings.sparkSession, "chroma")
    some = F.size("frames") > 0
    for c in keys:
        some = some & F.col(c).isNotNull()
    asked = scratch.cut(queries.select(*keys, "frames").withColumn("row", F.monotonically_increasing_id()))
    # The smallest keys of each class; numbers in the order of the classes' smallest keys, so that tasks cut ties as the result does.
    digest = F.md5(F.col("frames").cast("string"))
    smallest = Window.partitionBy("digest").orderBy(*keys)
    members = recordings.filter(some).select(*keys, "frames", digest.alias("digest")).withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= k + 1)
    members = scratch.cut(members.withColumn("frames", F.when(F.col("place") == 1, F.col("frames"))))
    heads = scratch.cut(members.filter("place = 1").sort(*keys).withColumn("class", F.monotonically_increasing_id()).select("class", "digest", "frames"))
    real = asked.filter(some)
    tiles = max(1, -(-(real.agg(F.coalesce(F.sum(F.size("frames")), F.lit(0))).first()[0]) // FRAMES))
    schema = "row bigint, class bigint, shift bigint, votes bigint, bit_error double, clip boolean"
    tiled = _tiles.tiled(real.select("row", "frames"), tiles, scratch.cut)
    # A class of the query alone takes a place without giving a match, hence k + 1.
    found = scratch.cut(_tiles.met(tiled, tiles, heads.select("class", "frames"), lambda _, t: _Tile(t, k + 1, least_votes, most_errors), schema, broadcast_bytes))
    order = ["clip", "bit_error", F.col("votes").desc()]
    best = Window.partitionBy("row").orderBy(*order, "class", "shift")
    found = found.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k + 1).drop("__n")
    named = members.join(heads.select("class", "digest"), "digest").select("class", *[F.col(c).alias(f"match_{c}") for c in keys])
    both = found.join(named, "class").join(asked.select("row", *keys), "row")
    if not own:
        same = F.lit(True)
        for c in keys:
            same = same & (F.col(c) == F.col(f"match_{c}"))
        both = both.filter(~same)
    best = Window.partitionBy("row").orderBy(*order, *[f"match_{c}" for c in keys], "shift")
    both = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop(*keys, "class")
    out = asked.select("row", *keys, F.coalesce(F.size("frames"), F.lit(0)).alias("n_frames")).join(both, "row", "left")
    return out.select(*keys, "n_frames", "rank", *[f"match_{c}" for c in keys], "shift", "votes", "bit_error", "clip")


def spoken(text: str) -> np.ndarray:
    """A text as tones, one of 24 pitches for each word: a stand-in for recorded speech."""
    from zlib import crc32

    words = text.encode().split()
    return _tones()[[crc32(w) % 24 for w in words]].ravel() if words else np.zeros(0, np.float32)


def clipped(text: str, words: int = 3, late: int = HOP // 32, noise: float = 0.01) -> np.ndarray:
    """``spoken``, recorded again: without its first words and a part of the next, and with noise that the text fixes."""
    from zlib import crc32

    samples = spoken(text)[words * HOP + late :]
    return samples + np.random.default_rng(crc32(text.encode())).normal(0.0, noise, len(samples)).astype(np.float32)


def _tones() -> np.ndarray:
    global _TONES
    if _TONES is None:
        t = np.arange(HOP) / RATE
        _TONES = np.stack([np.sin(2 * np.pi * 440.0 * 2 ** (p / 12) * t) for p in range(24)]).astype(np.float32) * 0.5
    return _TONES


_TONES: np.ndarray | None = None
