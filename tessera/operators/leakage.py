"""Leakage audits: which rows resemble which reference rows.

The reference side is a stated set (a benchmark, a test split).  The executors
deal it out to tiles of a bounded number of rows (``tiles``); a tile's sets
become an incidence matrix that every task lays over its packs of rows.  So all
pairs are counted exactly, none is emitted, and what leaves a task is a best
match or a pair above the threshold.  Rows are normalised and cut into tokens
once, however many tiles there are.

``nearest_peers`` compares a corpus with itself; its candidates come from
shared rare tokens, and nothing is lost above its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normalize, seq_ratio, seq_ratio_bound
from tessera.operators import tiles
from tessera.operators.layout import kept, spread
from tessera.operators.prefilter import bloom, split

BLOCK_ROWS = 2048
BLOCK_ENTRIES = 1 << 22


def exact_overlap(rows: DataFrame, targets: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """(id, key) against each target's (ref, key): (id, ref, target)."""
    out = None
    for name, target in targets.items():
        part = rows.join(target.select("ref", key), key).select("id", "ref", F.lit(name).alias("target"))
        out = part if out is None else out.unionByName(part)
    return out


class _Incidence:
    def __init__(self, refs: Sequence[tuple[object, list]]):
        import numpy as np

        self.np = np
        self.ids = [r for r, _ in refs]
        self.size = np.array([len(s) for _, s in refs])
        self.place: dict = {}
        rows: list[list[int]] = []
        for j, (_, s) in enumerate(refs):
            for x in s:
                i = self.place.setdefault(x, len(rows))
                if i == len(rows):
                    rows.append([])
                rows[i].append(j)
        self.flat = np.array([j for r in rows for j in r], np.int64)
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def jaccard(self, values: list):
        """With every reference: two empty sets are equal, an empty and another set share nothing."""
        np = self.np
        at = np.array([i for i in map(self.place.get, values) if i is not None], np.int64)
        if len(at):
            n = self.start[at + 1] - self.start[at]
            where = np.repeat(self.start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(self.flat[where], minlength=len(self.ids))
        else:
            both = np.zeros(len(self.ids), np.int64)
        union = self.size + len(values) - both
        return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _tile_count(rows: int, entries: int, block: int) -> int:
    return max(1, -(-rows // block), -(-entries // BLOCK_ENTRIES))


def _record(columns, kinds: dict) -> pa.RecordBatch:
    """Rows of values as a batch of the named Arrow types."""
    columns = list(zip(*columns)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


class _Overlap:
    """A tile of references against packs of rows: per reference or per row the best match, or all pairs from ``least`` on."""

    def __init__(self, refs: pa.Table, kinds: dict, per_ref: bool, least: float | None):
        import numpy as np

        self.np, self.kinds, self.per_ref, self.least = np, kinds, per_ref, least
        self.inc = _Incidence([(r, t or []) for r, t in zip(refs.column("ref").to_pylist(), refs.column("tokens").to_pylist())])
        self.best, self.at = np.full(len(self.inc.ids), -1.0), [None] * len(self.inc.ids)

    def offer(self, pack: pa.Table) -> pa.RecordBatch | None:
        np, ids, found = self.np, self.inc.ids, []
        for row, tokens in zip(pack.column("id").to_pylist(), pack.column("tokens").to_pylist()):
            sims = np.round(self.inc.jaccard(tokens or []), 9)
            if self.least is not None:
                found += [(row, ids[j], float(sims[j])) for j in np.flatnonzero(sims >= self.least)]
            elif self.per_ref:
                for j in np.flatnonzero(sims >= self.best).tolist():
                    if sims[j] > self.best[j] or row < self.at[j]:  # equal: the smaller id
                        self.best[j], self.at[j] = sims[j], row
            else:
                top = sims.max()
                found.append((row, min(ids[j] for j in np.flatnonzero(sims == top)), float(top)))
        return _record(found, self.kinds) if found else None

    def found(self) -> pa.RecordBatch:
        return _record([(self.at[j], self.inc.ids[j], float(self.best[j])) for j in self.np.flatnonzero(self.best >= 0)], self.kinds)


def _kinds(**columns) -> tuple[dict, str]:
    """Arrow types by name, and the schema for Spark."""
    from pyspark.sql.pandas.types import to_arrow_type

    return {n: to_arrow_type(t) for n, t in columns.items()}, ", ".join(f"{n} {t.simpleString()}" for n, t in columns.items())


def _overlaps(rows: DataFrame, refs: DataFrame, per_ref: bool, least: float | None) -> DataFrame:
    kinds, schema = _kinds(id=rows.schema["id"].dataType, ref=refs.schema["ref"].dataType, sim=T.DoubleType())
    stated = kept(refs.select("ref", "tokens"))
    many = stated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("tokens"), F.lit(0))), F.lit(0))).first()
    count = _tile_count(*many, BLOCK_ROWS)
    return tiles.met(tiles.tiled(stated, count), count, rows.select("id", "tokens"), lambda _, t: _Overlap(t, kinds, per_ref, least), schema)


def best_match_of_refs(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """For each ref (ref, tokens) the most similar row (id, tokens), ties to the smallest id: (ref, id, sim)."""
    found = _overlaps(rows, refs, True, None)
    w = Window.partitionBy("ref").orderBy(F.col("sim").desc(), "id")
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("ref", "id", "sim")


def best_match_of_rows(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """For each row its most similar ref, ties to the smallest ref: (id, ref, sim)."""
    found = _overlaps(rows, refs, False, None)
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "ref")).alias("m"))
    return best.select("id", F.col("m.ref").alias("ref"), (-F.col("m.s")).alias("sim"))


def similar_pairs(rows: DataFrame, refs: DataFrame, least: float) -> DataFrame:
    """All (id, ref, sim) of at least ``least``."""
    return _overlaps(rows, refs, False, least)


def threshold_counts(best: DataFrame, thresholds: Sequence[float] = (1.0, 0.9, 0.8, 0.7)) -> DataFrame:
    """L1: how many best similarities reach each threshold."""
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    each = best.withColumn("threshold", F.explode(steps))
    return each.groupBy("threshold").agg(F.sum((F.col("sim") >= F.col("threshold")).cast("bigint")).alias("n"))


def largest_similarity(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """One row, the largest similarity of all pairs; ties to the smallest ref, then id."""
    return best_match_of_refs(rows, refs).orderBy(F.col("sim").desc(), "ref", "id").limit(1)


PLACES = 24  # bits of a token's place among the counts
BLOCK = 16  # bits of a place within its block


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of tokens to (block, places, uses): how often a task's sets have the tokens of each place."""
    import numpy as np

    def merged(parts):
        at, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return at[first], np.add.reduceat(n, first) if len(first) else n

    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for batch in batches:
        at, n = np.unique((batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - PLACES)).astype(np.int64), return_counts=True)
        parts.append((at, n))
        if sum(len(x) for x, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
            parts = [merged(parts)]
    at, n = merged(parts)
    ends = np.searchsorted(at >> BLOCK, np.arange((1 << PLACES - BLOCK) + 1))
    rows = [(i, (at[x:y] & (1 << BLOCK) - 1).astype("<u2").tobytes(), n[x:y].astype("<u4").tobytes()) for i, (x, y) in enumerate(zip(ends, ends[1:])) if x < y]
    yield _record(rows, {"block": pa.int32(), "places": pa.binary(), "uses": pa.binary()})


def _steps(n):
    """Counts as bytes that keep their order: to 64 as they are, beyond seven steps for each doubling."""
    import numpy as np

    return np.minimum(np.where(n <= 64, n, 64 + np.floor(7 * np.log2(np.maximum(n, 64) / 64))), 255).astype("u1")


def _summed(rows: pa.Table) -> pa.Table:
    """A block's counts of all tasks, one byte a place."""
    import numpy as np

    total = np.zeros(1 << BLOCK, np.int64)
    for places, uses in zip(rows.column("places"), rows.column("uses")):
        total[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(uses.as_buffer(), "<u4")
    return pa.table({"block": rows.column("block")[:1], "uses": pa.array([_steps(total).tobytes()], pa.binary())})


def _rarest(uses, least: float):
    """(cls, hashes) to (cls, n, rarest): the size and the hashes that a set has to show, without those that no other row can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = np.zeros(1 << PLACES, np.uint8)
        for block, counts in uses.value:
            known[block << BLOCK : block + 1 << BLOCK] = np.frombuffer(counts, "u1")
        for batch in batches:
            hashes = batch.column(1)
            n = hashes.value_lengths().to_numpy().astype(np.int64)
            flat = hashes.flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            count = known[(flat >> np.uint64(64 - PLACES)).astype(np.int64)]
            order = np.lexsort((flat, count, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            take = (place < _shown(n, least, np)[row]) & (count[order] > 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[take], minlength=len(n)))])
            rarest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[order][take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), rarest], names=["cls", "n", "rarest"])

    return run


def _shown(n, least: float, np):
    """How many of its rarest tokens a set of ``n`` has to show."""
    return n - np.ceil(np.round(n * least, 9)).astype(np.int64) + 1


def nearest_peers(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """(id, tokens) to (id, peer, sim): each row's most similar other row of at least ``least``, ties to the smallest peer.

    Rows with one and the same set form a class; a member's peer is the
    smallest other one.  Classes are compared by prefixes: tokens are ordered
    by how many rows have them, the rarest first, and two sets of Jaccard
    similarity ``least`` share one of their first n - ceil(least n) + 1 tokens.
    So a token that everything has pairs no one, and no pair is lost.  Rows
    without tokens have no peer.

    Any order does that all sets keep: uses are counted by the places of hashes
    in a table of ``1 << PLACES`` bytes that every task gets, coarser the more
    uses there are but without an end, and equal ones go by hash.  So occurrences aren't shuffled, a set shows its prefix where it
    is read, and tokens of one hash only make more candidates.  Of a pair that
    shares k shown tokens, the one whose prefix ends first shares no more than k
    and its rest; where that is too little, the pair goes before sets are sent
    for, and what is left is compared by its tokens.
    """
    some = rows.filter("id is not null").select("id", F.array_sort("tokens").alias("tokens")).withColumn("cls", F.unhex(F.md5(F.array_join("tokens", "\x1f"))))
    some = kept(some).filter("size(tokens) > 0")  # a filter ahead would make the tokens twice
    two = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    lowest = kept(some.select("cls", "id").withColumn("n", two).filter("n <= 2").groupBy("cls").agg(F.min("id").alias("low"), F.max(F.when(F.col("n") == 2, F.col("id"))).alias("next")))
    hashes = F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")
    uses = some.select(hashes).mapInArrow(_tallied, "block int, places binary, uses binary").groupBy("block").applyInArrow(_summed, "block int, uses binary")
    uses = some.sparkSession.sparkContext.broadcast([(r.block, bytes(r.uses)) for r in uses.collect()])
    rarest = some.select("cls", hashes).mapInArrow(_rarest(uses, least), "cls binary, n int, rarest array<bigint>").filter("size(rarest) > 0")
    named = kept(rarest.groupBy("cls").agg(F.first("n").alias("n"), F.first("rarest").alias("rarest")).withColumn("key", F.monotonically_increasing_id()))
    shown = named.select("key", "n", F.explode("rarest").alias("token"))
    x, y = (shown.select(F.col("token").alias(f"t_{c}"), F.col("key").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    alike = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-9)
    rest = lambda c: F.ceil(F.round(F.col(c) * least, 9)) - 1
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * F.lit(least / (1 + least)) - 1e-6) - F.greatest(rest("n_a"), rest("n_b"))
    pairs = x.join(y, (F.col("t_a") == F.col("t_b")) & alike).groupBy("a", "b", needed.alias("needed")).agg(F.count(F.lit(1)).alias("k")).filter("k >= needed").select("a", "b")
    name = lambda c: named.select(F.col("key").alias(c), F.col("cls").alias(f"cls_{c}"))
    pairs = kept(pairs.join(name("a"), "a").join(name("b"), "b").select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    sets = kept(split(some, *bloom(asked, "cls"), "cls")[0].select("cls", "tokens").dropDuplicates(["cls"]))
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    sim = F.round(both / (F.size("tokens_a") + F.size("tokens_b") - both), 9)
    near = kept(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", sim.alias("sim")).filter(F.col("sim") >= least))
    each = near.select(F.col("a").alias("cls"), F.col("b").alias("other"), "sim").unionByName(near.select(F.col("b").alias("cls"), F.col("a").alias("other"), "sim"))
    each = each.join(lowest.select(F.col("cls").alias("other"), F.col("low").alias("peer")), "other")
    of_class = each.groupBy("cls").agg(F.min(F.struct((-F.col("sim")).alias("s"), "peer")).alias("m"))
    out = some.select("id", "cls").join(lowest, "cls").join(of_class, "cls", "left")
    twin = F.when(F.col("next").isNotNull(), F.when(F.col("id") == F.col("low"), F.col("next")).otherwise(F.col("low")))
    return out.select("id", F.coalesce(twin, F.col("m.peer")).alias("peer"), F.when(twin.isNotNull(), 1.0).otherwise(-F.col("m.s")).alias("sim")).filter("peer is not null")


def labelled_matches(rows: DataFrame, targets: dict[str, DataFrame], least: float = 0.6) -> DataFrame:
    """L2, L3: for each row (ref, text, tokens) its best match in each target (id, text, tokens) from ``least`` on: (ref, target, id, sim, label).

    ``label`` is EXACT where the texts are equal, else SIM; texts and tokens are normalised by the caller.
    """
    out = None
    for name, target in targets.items():
        best = best_match_of_refs(target.select("id", "tokens"), rows.select("ref", "tokens")).filter(F.col("sim") >= least)
        exact = rows.select("ref", "text").join(target.select(F.col("id").alias("__id"), "text"), "text").select("ref", "__id")
        named = best.join(exact, (best["ref"] == exact["ref"]) & (best["id"] == exact["__id"]), "left").select(best["ref"], F.lit(name).alias("target"), "id", "sim", F.when(F.col("__id").isNotNull(), "EXACT").otherwise("SIM").alias("label")).distinct()
        out = named if out is None else out.unionByName(named)
    return out


def measures_apart(rows: DataFrame, refs: DataFrame, thresholds: Sequence[float] = (1.0, 0.9, 0.8, 0.7), kind: str = "leak") -> DataFrame:
    """L1: how many of ``rows`` (id, text) reach each threshold with their best token Jaccard and, kept apart, their best sequence ratio among ``refs`` (ref, text)."""
    from tessera.functions.text import token_set

    tokens = lambda t, c: t.select(F.col(c).alias("ref" if c == "id" else "id"), token_set(normalize(F.col("text"), kind)).alias("tokens"))
    words = best_match_of_refs(tokens(refs, "ref"), tokens(rows, "id")).select("sim")
    letters = audit(rows, refs, kind, steps=thresholds).select(F.col("ratio").alias("sim"))
    return threshold_counts(words, thresholds).withColumn("measure", F.lit("tokens")).unionByName(threshold_counts(letters, thresholds).withColumn("measure", F.lit("sequence")))


def frozen_audit(train: DataFrame, held_out: DataFrame, label: str, least: float = 0.9, kind: str = "split") -> DataFrame:
    """(check, found, passed) of a frozen split: ids and normalised texts unique and disjoint, classes covered, no pair of texts as alike as ``least``.

    Both sides: id, text and ``label``; the held-out side is the stated set.
    """
    sides = {n: t.select(F.col("id").cast("string").alias("id"), normalize(F.col("text"), kind).alias("text"), F.col(label).alias("label")) for n, t in (("train", train), ("held_out", held_out))}
    repeated = lambda t, c: t.groupBy(c).count().filter("count > 1").agg(F.count(F.lit(1)).cast("double").alias("found"))
    shared = lambda c: sides["train"].select(c).distinct().join(sides["held_out"].select(c), c, "left_semi").agg(F.count(F.lit(1)).cast("double").alias("found"))
    lacking = sides["train"].select("label").distinct().join(sides["held_out"].select("label"), "label", "left_anti").agg(F.count(F.lit(1)).cast("double").alias("found"))
    closest = audit(held_out.select("id", "text"), train.select(F.col("id").alias("ref"), "text"), kind, largest=True).agg(F.coalesce(F.max("ratio"), F.lit(0.0)).alias("found"))
    checks = {
        "repeated ids in train": repeated(sides["train"], "id"), "repeated texts in train": repeated(sides["train"], "text"), "shared ids": shared("id"), "shared texts": shared("text"), "classes that only train has": lacking,
        "largest sequence ratio": closest,
    }
    out = None
    for name, found in checks.items():
        bound = F.col("found") < least if name == "largest sequence ratio" else F.col("found") == 0
        row = found.select(F.lit(name).alias("check"), "found", bound.alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def audit_sources(rows: DataFrame, sources: dict[str, DataFrame], kind: str = "bench", **bounds) -> DataFrame:
    """``audit`` against each of several sources: (source, id, ref, ratio, gram, leaks)."""
    out = None
    for name, refs in sources.items():
        part = audit(rows, refs, kind, **bounds).select(F.lit(name).alias("source"), "id", "ref", "ratio", "gram", "leaks")
        out = part if out is None else out.unionByName(part)
    return out


def sequence_pairs(pairs: DataFrame, left: Column, right: Column, least: float) -> DataFrame:
    """Candidate pairs whose Ratcliff-Obershelp ratio reaches ``least``.

    Pairs whose lengths rule it out are dropped before Python sees them, which
    loses none.
    """
    close = pairs.withColumns({"__l": left, "__r": right}).filter(seq_ratio_bound(F.col("__l"), F.col("__r")) >= least)
    return close.withColumn("ratio", seq_ratio(F.col("__l"), F.col("__r"))).filter(F.col("ratio") >= least).drop("__l", "__r")


class _Sequences:
    """A block of texts as first argument of Ratcliff-Obershelp ratios.

    ``bounds`` is never below a ratio.  Matched letters are common letters.  In
    texts of 200 letters or more difflib starts a match at rare letters only
    (its autojunk), apart from a match at the beginning of both; so there the
    longest runs through the rare letters, summed, bound the matched letters too.
    """

    def __init__(self, texts: Sequence[str]):
        import numpy as np

        self.np, self.texts = np, texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.counts = np.array([self._counts(self._codes(t)) for t in texts]).reshape(len(texts), 64).astype(np.int32)
        edge = np.array([0xFFFFFFFE], np.uint32)  # no letter; on both sides of each text
        self.all = np.concatenate([edge, *(x for t in texts for x in (self._codes(t), edge))])
        self.start = 1 + np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(texts) + 1), np.concatenate([[1], self.size + 1])) - 1
        self.order = np.argsort(self.all, kind="stable")
        self.values = self.all[self.order]

        self.wide = [n // 8 + 1 for n in self.size.tolist()]  # bytes; a bit at least is left for the carry
        self.masks: list[dict[str, bytes]] = []
        self.bits: list[dict[str, int]] = []
        for t, w in zip(texts, self.wide):
            at: dict[str, int] = {}
            for i, c in enumerate(t):
                at[c] = at.get(c, 0) | 1 << i
            self.masks.append({c: m.to_bytes(w, "little") for c, m in at.items()})
            self.bits.append(at)

    def _codes(self, text: str):
        return self.np.frombuffer(text.encode("utf-32-le"), self.np.uint32)

    def _counts(self, codes):
        return self.np.bincount(codes & 63, minlength=64)

    def bounds(self, text: str, least):
        """For each text of the block; exact enough to tell which can reach ``least`` (an array)."""
        np, codes = self.np, self._codes(text)
        total = self.size + len(codes)
        scale = lambda m: np.where(total > 0, 2.0 * m / np.maximum(total, 1), 1.0)
        live = scale(np.minimum(self.size, len(codes))) >= least
        if not live.any():
            return np.where(live, 1.0, -1.0)
        most = np.where(live, np.minimum(self.counts, self._counts(codes).astype(np.int32)).sum(1), -1)
        live &= scale(most) >= least
        if len(codes) >= 200 and live.any():
            most = np.where(live, np.minimum(most, self._anchored(codes, live)), -1)
        return np.where(live, scale(most), -1.0)

    def _anchored(self, codes, live):
        np = self.np
        found, back, n = np.unique(codes, return_inverse=True, return_counts=True)
        at = np.flatnonzero((n <= len(codes) // 100 + 1)[back])
        a, b = np.searchsorted(self.values, codes[at], "left"), np.searchsorted(self.values, codes[at], "right")
        n = b - a
        i = self.order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(at) else np.zeros(0, np.int64)
        j = np.repeat(at, n)
        mine = live[self.owner[i]]
        i, j = i[mine], j[mine] + 1
        padded = np.concatenate([[0xFFFFFFFF], codes, [0xFFFFFFFF]]).astype(np.uint32)
        run = np.ones(len(i), np.int64)
        for step in (1, -1):
            who, x, y = np.arange(len(i)), i, j
            while len(who):
                x, y = x + step, y + step
                same = self.all[x] == padded[y]
                who, x, y = who[same], x[same], y[same]
                run[who] += 1
        longest = np.zeros(len(self.all), np.int64)
        np.maximum.at(longest, i, run)
        most = np.bincount(np.maximum(self.owner, 0), longest, len(self.texts)).astype(np.int64)
        for k in np.flatnonzero(live):
            p = self.all[self.start[k] : self.start[k] + min(self.size[k], len(codes))] == codes[: self.size[k]]
            most[k] += len(p) if p.all() else int(p.argmin())
        return most

    def codes(self, k: int):
        return self.all[self.start[k] : self.start[k] + self.size[k]]

    def common(self, text: str, which: list[int]) -> list[int]:
        """Lengths of the longest common subsequences with some texts, by bits side by side; matching blocks have no more letters."""
        lay = lambda parts: int.from_bytes(b"".join(parts), "little")
        none = [bytes(self.wide[k]) for k in which]
        free = full = lay(((1 << len(self.texts[k])) - 1).to_bytes(self.wide[k], "little") for k in which)
        masks = {c: lay(self.masks[k].get(c, z) for k, z in zip(which, none)) for c in set(text)}
        for c in text:
            m = masks[c] & free
            free = ((free + m) | (free - m)) & full
        left, out, a = free.to_bytes(sum(self.wide[k] for k in which), "little"), [], 0
        for k in which:
            out.append(len(self.texts[k]) - int.from_bytes(left[a : a + self.wide[k]], "little").bit_count())
            a += self.wide[k]
        return out


    ROUNDS, FEW = 12, 2  # after so many rounds, and of so few texts, ratios are computed one by one

    def reaching(self, text: str, which: Sequence[int], least) -> list[tuple[int, float]]:
        """(k, ratio) of the texts ``which`` whose Ratcliff-Obershelp ratio to ``text`` is ``least[k]`` or more.

        As ``_Ratio.reaching``, but side by side: after the longest common
        subsequences of whole texts, a round finds the longest block of every
        open region of every text, and the longest common subsequences left
        and right of them.  Most texts go in the first rounds.
        """
        np, codes = self.np, self._codes(text)
        ratio, out = _Ratio(text, codes), []
        rare = ratio.rare.tolist() if ratio.rare is not None else None
        total: dict[int, int] = {}
        regions: list[tuple[int, int, int, int, int]] = []  # text, its letters from and to, letters of ``text`` from and to
        for k in which:
            total[k] = len(self.texts[k]) + len(text)
            if text and self.texts[k]:
                regions.append((k, 0, len(self.texts[k]), 0, len(text)))
            else:
                out.append((k, ratio.exact(self.texts[k])))
        most = self._subsequences(text, codes, regions) if regions else []
        upto = {r[0]: m for r, m in zip(regions, most)}
        regions = [r for r, m in zip(regions, most) if 2.0 * m / total[r[0]] >= least[r[0]]]
        found = {r[0]: 0 for r in regions}
        for _ in range(self.ROUNDS):
            if not regions or len(found) <= self.FEW:
                break
            parts = []
            for (k, a, b, c, d), block in zip(regions, self._blocks(text, codes, rare, regions)):
                i, j, size = ratio.widened(self.texts[k], a, b, c, d, *block)
                if size:
                    found[k] += size
                    parts += [(k, *r) for r in ((a, i, c, j), (i + size, b, j + size, d)) if r[0] < r[1] and r[2] < r[3]]
            bound = dict(found)
            lengths = self._subsequences(text, codes, parts) if parts else []
            for part, n in zip(parts, lengths):
                bound[part[0]] += n
            found = {k: n for k, n in found.items() if 2.0 * bound[k] / total[k] >= least[k]}
            regions = [part for part, n in zip(parts, lengths) if n and part[0] in found]
        left = {r[0] for r in regions}
        out += [(k, ratio.reaching(self.texts[k], self.codes(k), self.bits[k], upto[k], least[k]) if k in left else 2.0 * n / total[k]) for k, n in found.items()]
        return [(k, r) for k, r in out if r is not None and r >= least[k]]

    def _laid(self, codes, regions):
        """Where each region's letters begin, one more between any two; the letters of ``text`` as numbers; for each, where the regions have it."""
        np, edge = self.np, self.all[:1]
        starts = np.concatenate([[0], np.cumsum([b - a + 1 for _, a, b, _, _ in regions])])
        letters, at = np.unique(codes, return_inverse=True)
        laid = np.concatenate([x for k, a, b, _, _ in regions for x in (self.codes(k)[a:b], edge)])
        return starts, at.tolist(), letters[:, None] == laid[None, :]

    def _blocks(self, text: str, codes, rare, regions) -> list[tuple[int, int, int]]:
        """Each region's longest block (i, j, size), the earliest of several, of letters that aren't popular."""
        np = self.np
        starts, at, equal = self._laid(codes, regions)
        longest = max(min(b - a, d - c) for _, a, b, c, d in regions)
        kind = np.uint8 if longest < 255 else np.uint16 if longest < 65535 else np.int64
        masks = list(equal.astype(kind))
        whole = all(c == 0 and d == len(text) for *_, c, d in regions)
        events: dict[int, list[tuple[int, int, int]]] = {}
        if not whole:
            for r, (_, _, _, c, d) in enumerate(regions):
                events.setdefault(c, []).append((starts[r], starts[r + 1], 1))
                events.setdefault(d, []).append((starts[r], starts[r + 1], 0))
        size = int(starts[-1])
        active, run, best = np.zeros(size, kind), np.zeros(size + 1, kind), np.zeros(size, kind)
        before, now, step, some = run[:-1], run[1:], np.zeros(size, kind), False
        for p, x in enumerate(at):
            for u, v, on in events.get(p, ()):
                active[u:v] = on
            if rare is not None and not rare[p]:
                if some:
                    run.fill(0)
                    some = False
                continue
            np.add(before, 1, out=step)
            np.multiply(step, masks[x], out=now)
            if not whole:
                np.multiply(now, active, out=now)
            np.maximum(best, now, out=best)
            some = True
        sizes = np.maximum.reduceat(best, starts[:-1]).astype(np.int64)
        hits = np.flatnonzero(best == np.repeat(sizes.astype(kind), np.diff(starts)))
        ends = hits[np.searchsorted(hits, starts[:-1])] - starts[:-1]
        out = []
        for (k, a, _, c, d), n, e in zip(regions, sizes.tolist(), ends.tolist()):
            i = a + e - n + 1
            out.append((i, text.find(self.texts[k][i : i + n], c, d), n) if n else (a, c, 0))
        return out

    def _subsequences(self, text: str, codes, regions) -> list[int]:
        """Lengths of the regions' longest common subsequences."""
        np = self.np
        starts, at, equal = self._laid(codes, regions)
        masks = [int.from_bytes(m.tobytes(), "little") for m in np.packbits(equal, axis=1, bitorder="little")]
        events: dict[int, int] = {}
        full = 0
        for u, (_, a, b, c, d) in zip(starts.tolist(), regions):
            mine = ((1 << b - a) - 1) << u
            full |= mine
            events[c], events[d] = events.get(c, 0) ^ mine, events.get(d, 0) ^ mine
        free, active = full, 0
        for p, x in enumerate(at):
            if p in events:
                active ^= events[p]
            if active:
                m = masks[x] & free & active
                free = ((free + m) | (free - m)) & full
        left = np.unpackbits(np.frombuffer(free.to_bytes(int(starts[-1]) // 8 + 1, "little"), np.uint8), bitorder="little")
        rest = np.add.reduceat(left[: starts[-1]].astype(np.int64), starts[:-1]).tolist()
        return [b - a - n for (_, a, b, _, _), n in zip(regions, rest)]


class _Ratio:
    """Ratcliff-Obershelp ratios to one and the same second text, as difflib gives them, or nothing where they can't reach a bound.

    The longest block of a region is found in the matrix of equal letters; what
    is left and right of it has no more matched letters than its longest common
    subsequence.  So most pairs are dropped after a few blocks; after
    ``BLOCKS`` difflib computes it.
    """

    BLOCKS = 40
    AUTOJUNK = 200  # letters from which difflib leaves popular ones out

    def __init__(self, text: str, codes):
        import numpy as np

        self.np, self.text, self.codes, self.match, self.rare = np, text, codes, None, None
        if len(text) >= self.AUTOJUNK:
            _, back, n = np.unique(codes, return_inverse=True, return_counts=True)
            self.rare = (n <= len(text) // 100 + 1)[back]

    def exact(self, other: str) -> float:
        from difflib import SequenceMatcher

        self.match = self.match or SequenceMatcher(None, "", self.text)
        self.match.set_seq1(other)
        return self.match.ratio()

    def _block(self, other: str, equal, a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
        """The longest block of letters a to b of ``other`` and c to d of the text, the earliest of several."""
        all_ = equal[a:b, c:d]
        if not all_.any():
            i, j, size = a, c, 0
        else:
            size, runs = 1, all_
            while (longer := runs[:-1, :-1] & all_[size:, size:]).any():
                runs, size = longer, size + 1
            i, j = divmod(int(runs.argmax()), runs.shape[1])
            i, j = a + i, c + j
        return self.widened(other, a, b, c, d, i, j, size)

    def widened(self, other: str, a: int, b: int, c: int, d: int, i: int, j: int, size: int) -> tuple[int, int, int]:
        """A block with the equal letters on both sides of it, popular ones as well."""
        text = self.text
        while i > a and j > c and other[i - 1] == text[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < b and j + size < d and other[i + size] == text[j + size]:
            size += 1
        return i, j, size

    def _most(self, masks: dict[str, int], a: int, b: int, c: int, d: int) -> int:
        """The longest common subsequence of a region."""
        free = full = (1 << b - a) - 1
        for x in self.text[c:d]:
            m = (masks.get(x, 0) >> a) & free
            free = ((free + m) | (free - m)) & full
        return b - a - free.bit_count()

    def reaching(self, other: str, codes, masks: dict[str, int], most: int, least: float) -> float | None:
        """The ratio of ``other``, if it is ``least`` or more; ``most`` letters are matched at most."""
        total = len(other) + len(self.text)
        if total == 0 or not other or not self.text:
            return self.exact(other)
        equal = codes[:, None] == self.codes[None, :]
        if self.rare is not None:
            equal &= self.rare
        regions, found = [(most, 0, len(other), 0, len(self.text))], 0
        for _ in range(self.BLOCKS):
            if not regions:
                return 2.0 * found / total
            regions.sort()
            bound, a, b, c, d = regions.pop()
            i, j, size = self._block(other, equal, a, b, c, d)
            most -= bound
            if size:
                found, most = found + size, most + size
                for region in ((a, i, c, j), (i + size, b, j + size, d)):
                    if region[0] < region[1] and region[2] < region[3] and (n := self._most(masks, *region)):
                        regions.append((n, *region))
                        most += n
            if 2.0 * most / total < least:
                return None
        return self.exact(other)


class _Matches:
    """A tile of references against packs of rows: all pairs with a ratio from ``least`` on."""

    def __init__(self, refs: pa.Table, kinds: dict, least: float):
        import numpy as np

        self.np, self.kinds, self.least = np, kinds, least
        self.refs = refs.column("ref").to_pylist()
        self.known = _Sequences(refs.column("text").to_pylist())
        self.floor = np.full(len(self.refs), least)

    def offer(self, pack: pa.Table) -> pa.RecordBatch | None:
        found = []
        for row, text in zip(pack.column("id").to_pylist(), pack.column("text").to_pylist()):
            match = _Ratio(text, self.known._codes(text))
            live = self.np.flatnonzero(self.known.bounds(text, self.floor) >= self.least).tolist()
            if not live:
                continue
            for k, most in zip(live, self.known.common(text, live)):
                other = self.known.texts[k]
                if other and text and 2.0 * most / (len(other) + len(text)) < self.least:
                    continue
                ratio = match.reaching(other, self.known.codes(k), self.known.bits[k], most, self.least)
                if ratio is not None and ratio >= self.least:
                    found.append((self.refs[k], row, ratio))
        return _record(found, self.kinds) if found else None

    def found(self) -> pa.RecordBatch:
        return _record([], self.kinds)


def sequence_matches(rows: DataFrame, refs: DataFrame, least: float, block: int = BLOCK_ROWS) -> DataFrame:
    """All (ref, id, ratio) with the ratio of ref's text (ref, text) to the row's (id, text) at least ``least``.

    References are a stated set; every row meets every reference.  Only pairs
    that an upper bound rules out aren't computed.
    """
    kinds, schema = _kinds(ref=refs.schema["ref"].dataType, id=rows.schema["id"].dataType, ratio=T.DoubleType())
    stated = kept(refs.filter("text is not null").select("ref", "text"))
    count = _tile_count(*stated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first(), block)
    dealt = spread(rows.filter("text is not null").select("id", "text"))
    return tiles.met(tiles.tiled(stated, count), count, dealt, lambda _, t: _Matches(t, kinds, least), schema)


class _Closest:
    """A tile of fresh rows against packs of references: each row's best one by ratio, then trigrams, then the smallest.

    With ``steps``, of each row one of those references that reach the highest
    step; with ``largest``, one of largest ratio of all pairs among the rows.
    """

    def __init__(self, fresh: pa.Table, kinds: dict, own: bool, steps: Sequence[float] | None = None, largest: bool = False):
        import numpy as np

        self.np, self.kinds, self.own, self.steps, self.largest = np, kinds, own, sorted(steps or ()), largest
        self.ids = fresh.column("id").to_pylist()
        self.known = _Sequences(fresh.column("t").to_pylist())
        self.sets = [self._grams(t) for t in self.known.texts]
        self.least, self.best = np.full(len(self.ids), -0.5), [None] * len(self.ids)

    @staticmethod
    def _grams(text: str) -> set[str]:
        return {text[i : i + 3] for i in range(max(1, len(text) - 2))}

    def _floor(self, ratio: float) -> float:
        """What a row must reach next."""
        return next((s for s in self.steps if s > ratio), float("inf")) if self.steps else ratio

    def offer(self, pack: pa.Table) -> None:
        known, least, best = self.known, self.least, self.best
        pairs = zip(pack.column("ref").to_pylist(), pack.column("t").to_pylist())
        for ref, text in sorted(pairs, key=lambda p: len(p[1])):  # short ones are the most alike
            live = self.np.flatnonzero(known.bounds(text, least) >= least).tolist()
            if not live:
                continue
            live, theirs = [k for k in live if self.own or self.ids[k] != ref], None
            for k, ratio in known.reaching(text, live, least) if live else ():
                if ratio >= least[k]:
                    theirs = self._grams(text) if theirs is None else theirs
                    now = (-ratio, -len(self.sets[k] & theirs) / len(self.sets[k] | theirs), ref)
                    if best[k] is None or now < best[k]:
                        best[k], least[k] = now, self._floor(ratio)
                        if self.largest and ratio > least.max(initial=-1.0, where=self.np.arange(len(least)) != k):
                            least[:] = ratio

    def found(self) -> pa.RecordBatch:
        return _record([(i, b[2], -b[0], -b[1]) for i, b in zip(self.ids, self.best) if b], self.kinds)


def audit(rows: DataFrame, refs: DataFrame, kind: str = "fresh", seq_least: float = 0.9, gram_least: float = 0.7, block: int = BLOCK_ROWS, own: bool = True, steps: Sequence[float] | None = None, largest: bool = False) -> DataFrame:
    """L4, L5, and with ``own`` false J9 of a stated set, in which no row is its own reference: for each row (id, text) its best reference (ref, text) by sequence ratio, then trigram Jaccard, then the smallest.

    Only the row's best reference is tested against the n-gram threshold.
    Rows are the fresh set, in tiles; references may be a whole corpus.  A
    reference that an upper bound puts below the row's best so far isn't
    computed; each task returns one reference a row.

    Where only the steps matter that a row's best ratio reaches, or the largest
    ratio of all, ``steps`` or ``largest`` says so: then the reference is one
    that reaches the row's highest step, or only that largest ratio is meant.
    """
    plain = lambda c: F.coalesce(normalize(F.col(c), kind), F.lit(""))
    fresh, asked = kept(rows.select("id", plain("text").alias("t"))), refs.select("ref", plain("text").alias("t"))
    kinds, schema = _kinds(id=rows.schema["id"].dataType, ref=refs.schema["ref"].dataType, ratio=T.DoubleType(), gram=T.DoubleType())
    count = _tile_count(*fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first(), block)
    out = tiles.met(tiles.tiled(fresh, count), count, spread(asked), lambda _, t: _Closest(t, kinds, own, steps, largest), schema)
    first = F.struct((-F.col("ratio")).alias("r"), (-F.col("gram")).alias("g"), "ref")
    best = out.groupBy("id").agg(F.min(first).alias("m")).select("id", "m.ref", (-F.col("m.r")).alias("ratio"), (-F.col("m.g")).alias("gram"))
    return best.withColumn("leaks", (F.col("ratio") >= seq_least) | (F.col("gram") >= gram_least))
