"""A metric index for Ratcliff-Obershelp ratios: pairs from a ratio on, without meeting every pair.

Of texts with n and m letters of which M are matched, U = n + m - 2M letters are
unmatched, and a ratio 2M / (n + m) of t or more means U <= (1 - t)(n + m).
Their letter counts then lie at most U apart in L1.  Between two matching blocks
lies an unmatched letter, so there are U + 1 blocks at most and all but U of the
matched letters' pairs of neighbours are common; the counts of such pairs lie at
most 3U apart.  Merging bins only brings counts nearer, so counts of hashed
letters and pairs have the same bounds.

Both are metrics: rows whose distances to a pivot differ by more can't match.
Rows get a level by length, so that matches lie in one level or two neighbouring
ones, and within a level one radius holds.  Cells are as wide as the radius along
the first pivots; the lower row looks from its own cell, the other one is put
into all cells within the radius of its own, so an equality join finds every
match.  All pivots and the lengths then filter, the texts' own counts again, and
what is left is computed.  Equal texts are one row.  Nothing is lost at any step;
tests compare with all pairs.

That is ``matches_between``, for two large sets.  The turns of one language are
so near each other that cells part few of them; so within one corpus
(``similar_texts``) texts meet in tiles of like length, by marks of letters and of
runs of four letters, then by the longest common subsequence.

Cases.  Null texts match nothing; empty ones match empty ones, with ratio 1.
Repeated texts are members of one class.  The ratio depends on the order of its
texts; it is that of a row's text, first, and the other's, second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.layout import kept, spread

LETTERS, PAIRS = 64, 1024  # bins
PIVOTS = 8
CELLS = ((0, 0), (1, 1), (1, 2), (0, 3))  # (0 letters, 1 pairs; pivot) that cells are made of
SLACK = 1e-6


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Of hashed letters and of hashed pairs of neighbouring letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.bincount(codes & (LETTERS - 1), minlength=LETTERS), np.bincount((codes[:-1] * 31 + codes[1:]) & (PAIRS - 1), minlength=PAIRS)


def may_reach(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    """Whether texts of these counts can have a ratio of ``least``."""
    most = (1 - least) * (x[0].sum() + y[0].sum()) + SLACK
    return np.abs(x[0] - y[0]).sum() <= most and np.abs(x[1] - y[1]).sum() <= 3 * most


def _distances(pivots: list[tuple[np.ndarray, np.ndarray]]):
    """(key, n, d): length and distances to all pivots, by letters and by pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = [], []
            for text in batch.column(1).to_pylist():
                mine = counts(text)
                n.append(len(text))
                d.append([int(np.abs(m - p).sum()) for m, ps in zip(mine, zip(*pivots), strict=True) for p in ps])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(d, pa.list_(pa.int32()))], names=["key", "n", "d"])

    return run


def _confirmed(least: float):
    """(a, b, x, y) to the ratios of x to y and of y to x, where one of them reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from difflib import SequenceMatcher

        for batch in batches:
            rows = []
            seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for text in (x, y):
                    if text not in seen:
                        seen[text] = counts(text)
                if may_reach(seen[x], seen[y], least):
                    there, back = (SequenceMatcher(None, p, q).ratio() for p, q in ((x, y), (y, x)))
                    if max(there, back) >= least:
                        rows.append((a, b, there, back))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.float64()) for i in range(4)], names=["a", "b", "there", "back"])

    return run


def _indexed(texts: DataFrame, pivots: list) -> DataFrame:
    """(key, n, level-free distances d) of texts that aren't empty."""
    return spread(texts.filter("text != ''").select("key", "text")).mapInArrow(_distances(pivots), "key bigint, n int, d array<int>")


def _place(which: tuple[int, int]) -> Column:
    metric, pivot = which
    return F.get("d", F.lit(metric * PIVOTS + pivot))


def candidates(low: DataFrame, high: DataFrame, least: float, itself: bool) -> DataFrame:
    """(a, b) of the indexed rows that can reach ``least``; ``a`` of ``low`` is at the same level as ``b`` of ``high`` or below it."""
    step = math.log((2 - least) / least) + 1e-9  # lengths of a match differ by this factor at most
    level = F.floor(F.log(F.col("n").cast("double")) / step)
    radius = lambda g: F.exp((g + 1) * step) * ((1 - least) * (1 + math.exp(step))) + SLACK
    width = lambda which: F.col("r") * (3.0 if which[0] else 1.0)
    cell = lambda x, which: F.floor(x / width(which))

    low = low.withColumn("level", level).withColumn("r", radius(F.col("level")))
    low = low.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("d").alias("d_a"), F.col("level").alias("level_a"), "level", *[cell(_place(w), w).alias(f"c{i}") for i, w in enumerate(CELLS)])
    high = high.withColumn("own", level).withColumn("level", F.explode(F.array("own", F.col("own") - 1))).withColumn("r", radius(F.col("level")))
    for i, w in enumerate(CELLS):
        high = high.withColumn(f"c{i}", F.explode(F.sequence(cell(_place(w) - width(w), w), cell(_place(w) + width(w), w))))
    high = high.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("d").alias("d_b"), F.col("own").alias("level_b"), "level", *[f"c{i}" for i in range(len(CELLS))])

    most = (F.col("n_a") + F.col("n_b")) * (1 - least) + SLACK
    near = F.abs(F.col("n_a") - F.col("n_b")) <= most
    for metric, p in product((0, 1), range(PIVOTS)):
        at = F.lit(metric * PIVOTS + p)
        near = near & (F.abs(F.get("d_a", at) - F.get("d_b", at)) <= most * (3 if metric else 1))
    once = (F.col("level_a") < F.col("level_b")) | (F.col("a") < F.col("b")) if itself else F.lit(True)
    return low.join(high, ["level", *[f"c{i}" for i in range(len(CELLS))]]).filter(near & once).select("a", "b")


def _pivots(texts: DataFrame, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of ``PIVOTS`` texts drawn by a hash; fewer texts are repeated."""
    some = texts.filter("text != ''").orderBy(F.xxhash64("text", F.lit(seed)), "key").limit(PIVOTS).collect()
    found = [counts(r.text) for r in some] or [counts("")]
    return [found[i % len(found)] for i in range(PIVOTS)]


def classes(rows: DataFrame) -> DataFrame:
    """(key, text) of the distinct texts of (id, text), a written table."""
    return kept(rows.filter("text is not null").select("text").distinct().select(F.monotonically_increasing_id().alias("key"), "text"))


GRAM, BITS = 4, 4096  # length of the runs of letters whose presence is marked, and bins
COUNTED, COUNTS = 3, 1024  # length of the runs that are counted, and bins
SHORT = 200  # from so many letters on difflib calls some popular
WIDTHS = ((300, 8), (550, 16), (1200, 32))  # texts of fewer letters, and into how many words of 64 bins their marks are folded first
LETTER_WORDS = 8  # of marks "this letter so often"
CELLS_AT_ONCE = 1 << 14  # pairs whose marks are compared in one step
PART_ROWS, PART_BYTES = 16_384, 16 << 20  # texts of a part of a level, about five times as much in a task
MARKS = {"n": pa.int64(), "starts": pa.int64(), "letters": pa.binary(LETTERS), "bits": pa.binary(BITS // 8)}


def _runs(codes: np.ndarray, q: int, bins: int) -> np.ndarray:
    """Bins of the runs of ``q`` letters."""
    n = max(0, len(codes) - q + 1)
    at = np.zeros(n, np.int64)
    for i in range(q):
        at = at * 1_000_003 + codes[i : i + n]
    return (at ^ at >> 17) & (bins - 1)


def _marks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the length, ``starts``, counts of hashed letters (255 at most) and marks of the hashed runs it has.

    ``starts``: in how many places of a second text difflib can start a block; letters that it calls popular start none in texts of ``SHORT`` letters or more.
    """
    n = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), n)
    letters = np.minimum(np.bincount(row * LETTERS + (codes & (LETTERS - 1)), minlength=len(texts) * LETTERS), 255).astype(np.uint8).reshape(-1, LETTERS)
    known = np.flatnonzero(np.bincount(codes))  # letters there are
    each = np.bincount(row * len(known) + np.searchsorted(known, codes), minlength=len(texts) * len(known)).reshape(len(texts), -1)
    starts = np.where(n < SHORT, n, (each * (each <= (n // 100 + 1)[:, None])).sum(1))
    at = _runs(codes, GRAM, BITS)
    inside = row[: len(at)] == row[GRAM - 1 : GRAM - 1 + len(at)]
    bits = np.zeros((len(texts), BITS), bool)
    bits[row[: len(at)][inside], at[inside]] = True
    return n, starts, letters, np.packbits(bits, axis=1, bitorder="little")


def _with_marks(texts: pa.Table, rows: int = 256) -> pa.Table:
    if "bits" in texts.column_names:
        return texts
    values = texts.column("text").to_pylist()
    parts = [_marks(values[i : i + rows]) for i in range(0, len(values), rows)]
    flat = [np.concatenate(x) for x in zip(*parts)] if parts else [[], [], [], []]
    columns = [pa.array([bytes(v) for v in x] if k >= 2 else x, t) for k, (x, t) in enumerate(zip(flat, MARKS.values()))]
    for name, column in zip(MARKS, columns):
        texts = texts.append_column(name, column)
    return texts


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Marks in ``width`` words: bins are merged."""
    while words.shape[1] > width:
        words = words[:, : words.shape[1] // 2] | words[:, words.shape[1] // 2 :]
    return words


class _Side:
    """Texts and marks in order of length, then key."""

    def __init__(self, table: pa.Table):
        table = _with_marks(table).combine_chunks().sort_by([("n", "ascending"), ("key", "ascending")])
        wide = lambda c, kind, width: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(-1, width)
        self.keys, self.texts = table.column("key").to_numpy(), table.column("text").to_pylist()
        self.size, self.starts = table.column("n").to_numpy(), table.column("starts").to_numpy()
        self.letters, self.words = wide("letters", np.uint8, LETTERS), wide("bits", np.uint64, BITS // 64)
        self.counts: dict[int, np.ndarray] = {}

    def counted(self, places: np.ndarray) -> np.ndarray:
        """Counts of the texts' runs of ``COUNTED`` letters, 255 at most."""
        for i in np.unique(places).tolist():
            if i not in self.counts:
                codes = np.frombuffer(self.texts[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                self.counts[i] = np.minimum(np.bincount(_runs(codes, COUNTED, COUNTS), minlength=COUNTS), 255).astype(np.uint8)
        return np.array([self.counts[i] for i in places.tolist()])


class _Alike:
    """A tile of texts against packs of texts that are shorter, or as long and of smaller keys: pairs of which one ratio reaches ``least``.

    Of U unmatched letters and K blocks, counts of runs of q letters lie at most
    U + 2 (q - 1) (K - 1) apart; K - 1 is U at most, and no more than the places
    where a block can start beside the first letters.  Bits in which two marks
    differ are no more than that, however bins are merged and whichever bits are
    left out.  So many pairs at once meet a few words of marks: of letters if
    texts are short, else of runs, as many words as the length wants.  The few
    that are left meet all marks, and the counts of letters and of runs of three.
    """

    def __init__(self, tile: pa.Table, least: float):
        self.least, self.factor = least, (2 - least) / least  # lengths of a match differ by this factor at most
        self.tile = _Side(tile)
        self.keys, self.texts, self.size = self.tile.keys, self.tile.texts, self.tile.size
        self.runs = {w: np.ascontiguousarray(_folded(self.tile.words, w).T) for w in {BITS // 64, *(w for _, w in WIDTHS)} if len(self.size)}
        short = self.tile.letters[: np.searchsorted(self.size, SHORT * self.factor)]
        share = np.array([(short >= k).mean(0) for k in range(1, int(short.max(initial=0)) + 1)]).reshape(-1, LETTERS)
        use = np.argsort(-(share * (1 - share)).ravel(), kind="stable")[: 64 * LETTER_WORDS]
        self.steps = use // LETTERS + 1, use % LETTERS  # the counts and letters whose marks part texts best
        self.often = np.ascontiguousarray(self._often(self.tile.letters).T)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)

    def _often(self, letters: np.ndarray) -> np.ndarray:
        marks = np.zeros((len(letters), 64 * LETTER_WORDS), bool)
        marks[:, : len(self.steps[0])] = letters[:, self.steps[1]] >= self.steps[0]
        return np.packbits(marks, axis=1, bitorder="little").view(np.uint64)

    def _near(self, key: int, codes: np.ndarray) -> np.ndarray:
        """Places of texts that no bound rules out."""
        text = codes.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        return np.concatenate([np.zeros(0, np.int64), *(j for _, j in self._left(_Side(pa.table({"key": [key], "text": [text]}))))])

    def _left(self, pack: _Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the pack and the tile of pairs that no bound rules out."""
        often = self._often(pack.letters)
        x = 0
        while x < len(pack.size):
            n = int(pack.size[x])
            y = min(x + 16, int(np.searchsorted(pack.size, n + n // 20, "right")))
            if n < SHORT:
                y = min(y, int(np.searchsorted(pack.size, SHORT)))
                mine, theirs, q = often[x:y], self.often, 1
            else:
                width = next((w for most, w in WIDTHS if n < most), BITS // 64)
                mine, theirs, q = _folded(pack.words[x:y], width), self.runs.get(width), GRAM
            low, high = np.searchsorted(self.size, n), np.searchsorted(self.size, pack.size[y - 1] * self.factor + SLACK, "right")
            step = CELLS_AT_ONCE // (y - x)
            for at in range(low, high, step):
                to = min(at + step, high)
                i, j = self._first(pack, slice(x, y), slice(at, to), mine, theirs, q)
                if len(i):
                    i, j = self._second(pack, i + x, j + at)
                    if len(i):
                        yield i, j
            x = y

    def _most(self, n, m, s, t, q: int) -> np.ndarray:
        """How far counts of runs of ``q`` letters of texts of ``n`` and ``m`` letters with ``s`` and ``t`` starts may lie apart."""
        most = (1 - self.least) * (n + m) + SLACK
        return most + 2 * (q - 1) * np.minimum(most, np.maximum(s, t)) if q > 1 else most

    def _first(self, pack: _Side, mine: slice, theirs: slice, x: np.ndarray, y: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (mine.stop - mine.start, theirs.stop - theirs.start)
        differ, bits, some, apart = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, np.uint8), np.zeros(shape, np.uint16)
        words = x.shape[1]
        for w in range(words):
            np.bitwise_xor(x[:, w, None], y[w, None, theirs], out=differ)
            if w % 3:  # three words have 192 bits
                some += np.bitwise_count(differ, out=bits)
            else:
                np.bitwise_count(differ, out=some)
            if w % 3 == 2 or w + 1 == words:
                apart += some
        share = lambda n: ((1 - self.least) * n * (1 + SLACK) + 0.01).astype(np.float32)  # noqa: E731  for it has seven digits only
        most = share(pack.size[mine])[:, None] + share(self.size[theirs])
        if q > 1:
            gaps = np.maximum(pack.starts[mine].astype(np.float32)[:, None], self.tile.starts[theirs].astype(np.float32))
            most += np.float32(2 * (q - 1)) * np.minimum(gaps, most, out=gaps)
        return np.nonzero(apart <= most)

    def _second(self, pack: _Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = pack.size[i], self.size[j]
        stay = ((m > n) | (m == n) & (self.keys[j] > pack.keys[i])) & (m <= n * self.factor + SLACK)
        i, j = i[stay], j[stay]
        l1 = lambda x, y: np.maximum(x, y) - np.minimum(x, y)
        for q, apart in (
            (GRAM, lambda i, j: np.bitwise_count(pack.words[i] ^ self.tile.words[j])),
            (1, lambda i, j: l1(pack.letters[i], self.tile.letters[j])),
            (COUNTED, lambda i, j: l1(pack.counted(i), self.tile.counted(j))),
        ):
            parts = [apart(i[k : k + 1024], j[k : k + 1024]).sum(1, dtype=np.int64) for k in range(0, len(i), 1024)]
            stay = np.concatenate(parts or [np.zeros(0, np.int64)]) <= self._most(pack.size[i], self.size[j], pack.starts[i], self.tile.starts[j], q)
            i, j = i[stay], j[stay]
        return i, j

    def offer(self, pack: pa.Table) -> pa.RecordBatch | None:
        from difflib import SequenceMatcher

        rows, mine = [], _Side(pack)
        for i, j in self._left(mine):
            order = np.argsort(i, kind="stable")
            masks: dict[str, int] = {}
            now = -1
            for p, k in zip(i[order].tolist(), j[order].tolist()):
                text, other = mine.texts[p], self.texts[k]
                if p != now:
                    masks, now = {}, p
                    for at, c in enumerate(text):
                        masks[c] = masks.get(c, 0) | 1 << at
                free = full = (1 << len(text)) - 1
                for c in other:  # the longest common subsequence, bit by bit
                    m = masks.get(c, 0) & free
                    free = ((free + m) | (free - m)) & full
                if 2.0 * (len(text) - free.bit_count()) / (len(text) + len(other)) >= self.least:
                    (a, first), (b, second) = sorted(((int(mine.keys[p]), text), (int(self.keys[k]), other)))
                    there, back = (SequenceMatcher(None, u, v).ratio() for u, v in ((first, second), (second, first)))
                    if max(there, back) >= self.least:
                        rows.append((a, b, there, back))
        return self._batch(rows) if rows else None

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.float64()) for i in range(4)], names=["a", "b", "there", "back"])


def _marked(step: float):
    """(key, text) with its marks and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _with_marks(pa.Table.from_batches([batch]))
            level = np.floor(np.log(out.column("n").to_numpy()) / step).astype(np.int32)
            yield from out.set_column(4, "letters", out.column("letters").cast(pa.binary())).set_column(5, "bits", out.column("bits").cast(pa.binary())).append_column("level", pa.array(level)).combine_chunks().to_batches()

    return run


def _placed(least: float):
    """(place, side, ...), in order: a place's tile (side 0), then its packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile, held = None, [], None
        for batch in batches:
            place, side = (batch.column(i).to_numpy() for i in range(2))
            ends = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(place)]
            for x, y in zip(ends, ends[1:]):
                if x == y:
                    continue
                if place[x] != now:
                    now, tile, held = place[x], [], None
                part = pa.Table.from_batches([batch.slice(x, y - x)])
                if side[x] == 0:
                    tile.append(part)
                elif tile:
                    held = held or _Alike(pa.concat_tables(tile), least)
                    if (some := held.offer(part)) is not None:
                        yield some

    return run


def similar_texts(texts: DataFrame, least: float) -> DataFrame:
    """(a, b, there, back): keys of different texts of (key, text), and the ratios of a to b and of b to a, one of which reaches ``least``.

    Texts get a level by length, so that those of a pair lie in one level or in
    two neighbouring ones; levels are dealt out to parts of bounded size.  A
    place has a part of a level as its tile, and a part of that level or the one
    below as its pack.
    """
    schema = "a bigint, b bigint, there double, back double"
    step = math.log((2 - least) / least) + 1e-9
    some = spread(texts.filter("text != ''").select("key", "text"))
    marked = kept(some.mapInArrow(_marked(step), "key bigint, text string, n bigint, starts bigint, letters binary, bits binary, level int"))
    levels = marked.groupBy("level").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("level").collect()
    if not levels:
        return texts.sparkSession.createDataFrame([], schema)
    parts = {r.level: max(-(-r.rows // PART_ROWS), -(-r.bytes // PART_BYTES)) for r in levels}
    packs = {k: n + parts.get(k - 1, 0) for k, n in parts.items()}
    first, total = {}, 0
    for k in parts:
        first[k], total = total, total + parts[k] * packs[k]
    of = lambda values, above=0: F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("level") + F.lit(above))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = marked.withColumn("part", F.pmod(F.xxhash64("key"), of(parts)).cast("int"))
    tile = rows.withColumn("other", upto(of(packs))).withColumn("place", of(first) + F.col("part") * of(packs) + F.col("other")).withColumn("side", F.lit(0))
    own = rows.withColumn("other", upto(of(parts))).withColumn("place", of(first) + F.col("other") * of(packs) + F.col("part")).withColumn("side", F.lit(1))
    above = rows.filter(F.col("level").isin([k for k in parts if k + 1 in parts])).withColumn("other", upto(of(parts, 1)))
    above = above.withColumn("place", of(first, 1) + F.col("other") * of(packs, 1) + of(parts, 1) + F.col("part")).withColumn("side", F.lit(1))
    sent = ["place", "side", "key", "text", *MARKS]
    spark = texts.sparkSession
    tasks = min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    both = tile.select(sent).unionByName(own.select(sent)).unionByName(above.select(sent))
    return both.repartition(tasks, "place").sortWithinPartitions("place", "side").mapInArrow(_placed(least), schema)


def matches_between(rows: DataFrame, refs: DataFrame, least: float, seed: int = 3) -> DataFrame:
    """All (ref, id, ratio) of (id, text) and (ref, text) whose ratio, of ref's text to the row's, reaches ``least``."""
    mine, theirs = classes(rows), classes(refs)
    pivots = _pivots(theirs, seed)
    index, known = kept(_indexed(mine, pivots)), kept(_indexed(theirs, pivots))
    over = candidates(index, known, least, itself=False)
    step = math.log((2 - least) / least) + 1e-9
    level = lambda c: F.floor(F.log(F.col(c).cast("double")) / step)
    under = candidates(known, index, least, itself=False).select(F.col("b").alias("a"), F.col("a").alias("b"))
    lengths = lambda t, k: t.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"))
    under = under.join(lengths(index, "a"), "a").join(lengths(known, "b"), "b").filter(level("n_b") < level("n_a")).select("a", "b")
    left, right = mine.select(F.col("key").alias("a"), F.col("text").alias("x")), theirs.select(F.col("key").alias("b"), F.col("text").alias("y"))
    found = over.unionByName(under).join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirmed(least), "a bigint, b bigint, there double, back double").filter(F.col("back") >= least)
    texts = found.join(left, "a").join(right, "b").select("x", "y", F.col("back").alias("ratio"))
    empty = rows.filter("text = ''").select("id").crossJoin(refs.filter("text = ''").select("ref")).select("ref", "id", F.lit(1.0).alias("ratio"))
    out = texts.join(rows.select("id", F.col("text").alias("x")), "x").join(refs.select("ref", F.col("text").alias("y")), "y").select("ref", "id", "ratio")
    return out.unionByName(empty)


def nearest_by_sequence(rows: DataFrame, least: float) -> DataFrame:
    """(id, peer, ratio) for each row of (id, text) that has another row with a ratio of ``least``: the one of largest ratio, then of smallest id.

    Of equal texts every row's peer is the smallest other id, with ratio 1.
    """
    rows = kept(rows.filter("text is not null").select("id", "text"))  # else the texts are made again by each use
    texts = classes(rows)
    links = kept(similar_texts(texts, least))
    both = links.select("a", "b", F.col("there").alias("ratio")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("ratio"))).filter(F.col("ratio") >= least)
    members = rows.groupBy("text").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    firsts = texts.join(members, "text").select("key", "first", "size")
    second = rows.join(members.filter("size > 1"), "text").filter(F.col("id") != F.col("first")).groupBy("text").agg(F.min("id").alias("second"))
    best = both.join(firsts.select(F.col("key").alias("b"), F.col("first").alias("peer")), "b")
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.col("ratio").desc(), "peer"))).filter("place = 1").select(F.col("a").alias("key"), "peer", "ratio")
    of_text = texts.join(best, "key", "left").join(firsts, "key").join(second, "text", "left").select("text", "peer", "ratio", "first", "second")
    own = F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second"))
    # Another text can have ratio 1 to this one only if it is equal, so a copy always comes first.
    found = rows.join(of_text, "text").select("id", F.when(F.col("second").isNotNull(), own).otherwise(F.col("peer")).alias("peer"), F.when(F.col("second").isNotNull(), 1.0).otherwise(F.col("ratio")).cast(T.DoubleType()).alias("ratio"))
    return found.filter("peer is not null")
