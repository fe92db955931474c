"""Collocations by prefix growth over contiguous phrases.

1. A first reading counts hashes of words and of word pairs.  Those that are
   frequent enough make a bitmap of bounded size that misses none of them.
2. A second reading projects: each occurrence of a frequent word is a pointer
   that carries what follows it in its piece, up to the longest phrase, cut
   where a pair is infrequent, for no frequent phrase goes on there.  Equal
   pointers are counted in the tasks and then summed.
3. One task for each prefix word gets the word's pointers in order and grows
   phrases to the right, depth first: the pointers that go on with the same
   word are the next prefix's, and growth stops below the least count.
   Prefixes with more than ``TASK`` different pointers are split by a hash of
   what follows; their parts' counts are summed, and the least count holds for
   the sums.
4. Candidates are scored at each cut by joins with the grown phrases' counts,
   those inside a longer one that is frequent enough go, and the best of each
   language stay, chosen in salted parts first.

Everything is per language, null being ``und``.  Scores are exact: 38 decimal
digits hold a * a * 1000000 for counts below 10**16.

Cases.  Null and empty texts have no words, nor have those of delimiters only.
Repeated rows count again.  Long texts are read in overlapping pieces, cut at
blanks or delimiters, each word counted where it starts.  Ties go to the
smaller phrase.  An empty table gives no rows.  Columns other than text and
lang aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bloom import bitmap, holds
from tessera.llm._store import Scratch, bound_batches, lean, spread
from tessera.operators.layout import lookup

SLICE = 2 << 20  # bytes of text looked at together
TASK = 8192
SALTS = (64, 4, 1)
UND = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BREAK = re.compile(rb"[ \t.,;:!?\n-\r]")
_WORD = re.compile(rb"[ \t]*[^ \t.,;:!?\n-\r]+")


def _parts(text: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """(piece, limit) of a text: words that start before ``limit`` are this piece's; the words after it are what may follow them."""
    start = 0
    while len(text) - start > SLICE:
        found = _BREAK.search(text, start + SLICE)
        cut = found.start() if found else len(text)
        end = cut
        for _ in range(longest - 1):
            if not (word := _WORD.match(text, end)):
                break
            end = word.end()
        yield text[start:end], cut - start
        start = cut
    yield text[start:], len(text) - start


def _slices(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[list[tuple[str, bytes, int]]]:
    held: list[tuple[str, bytes, int]] = []
    size = 0
    for batch in lean(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for piece, limit in _parts(text.as_py() or b"", longest):
                if held and size + len(piece) > SLICE:
                    yield held
                    held, size = [], 0
                held.append((lang, piece, limit))
                size += len(piece) + 1
    if held:
        yield held


class Words:
    """The words of a slice, as numbers of distinct (language, word)."""

    def __init__(self, rows: list[tuple[str, bytes, int]]):
        import xxhash

        data = _LOW[np.frombuffer(b"\n".join(r[1] for r in rows) + b"\n", np.uint8)]
        begin = np.cumsum([0, *(len(r[1]) + 1 for r in rows)])[:-1]
        self.langs = sorted({r[0] for r in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        lang = np.array([number[r[0]] for r in rows], np.int64)
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], kind != 0])))
        first, last = edge[::2], edge[1::2]
        row = np.searchsorted(begin, first, "right") - 1
        self.mine = first < (begin + np.array([r[2] for r in rows], np.int64))[row]  # counted here
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[first]
        offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
        spelt = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])]).dictionary_encode()
        code, self.lang_of_word = spelt.indices.to_numpy().astype(np.int64), lang[row]
        u, self.of = np.unique(self.lang_of_word * max(1, len(spelt.dictionary)) + code, return_inverse=True)
        self.lang, entry = np.divmod(u, max(1, len(spelt.dictionary)))
        self.spelt = spelt.dictionary.take(pa.array(entry))
        self.n = len(u)
        seeds = [xxhash.xxh3_64_intdigest(x) for x in self.langs]
        self.hash = np.array([xxhash.xxh3_64_intdigest(w, seeds[k]) for w, k in zip(self.spelt.to_pylist(), self.lang.tolist(), strict=True)], np.uint64)

    def goes_on(self) -> np.ndarray:
        """Which words have a next one in their piece."""
        return np.append(self.piece[1:] == self.piece[:-1], False) if len(self.piece) else np.zeros(0, bool)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where, which, hashes): words with a next one, the number of the pair they make, hashes of the distinct pairs."""
        where = np.flatnonzero(self.goes_on())
        pair, which = np.unique(self.of[where] * self.n + self.of[where + 1], return_inverse=True)
        a, b = np.divmod(pair, max(1, self.n))
        x = self.hash[a] * np.uint64(0x9E3779B97F4A7C15) + self.hash[b]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return where, which, x ^ (x >> np.uint64(29))


def _hash_counts(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, longest):
            words = Words(rows)
            where, which, hashes = words.pairs()
            counts = np.concatenate([np.bincount(words.of[words.mine], minlength=words.n), np.bincount(which[words.mine[where]], minlength=len(hashes))])
            found = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([words.hash, hashes])[found].view(np.int64)), pa.array(counts[found])], names=["h", "c"])

    return run


def _pointers(longest: int, bits):
    """(lang, w1, ..., c): counted pointers; w1 is null in the rows that count all words of a language."""
    names = ["lang", *(f"w{i}" for i in range(1, longest + 1)), "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for rows in _slices(batches, longest):
            words = Words(rows)
            where, which, hashes = words.pairs()
            on = np.zeros(len(words.of), bool)  # goes on with a pair that may be frequent
            on[where] = holds(known, hashes)[which]
            start = np.flatnonzero(words.mine & holds(known, words.hash)[words.of])
            path, alive = [words.of[start]], np.ones(len(start), bool)
            for step in range(1, longest):
                alive = alive & on[np.minimum(start + step - 1, len(on) - 1)]
                path.append(np.where(alive, words.of[np.minimum(start + step, len(on) - 1)], -1))
            key = np.zeros(len(start), np.int64)
            for column in path:
                _, key = np.unique(key * (words.n + 1) + column + 1, return_inverse=True)
            _, at, counts = np.unique(key, return_index=True, return_counts=True)
            totals = np.bincount(words.lang_of_word[words.mine], minlength=len(words.langs))
            langs = pa.array(words.langs, pa.string())
            columns = [pa.chunked_array([langs.take(pa.array(words.lang[path[0][at]])), langs]).combine_chunks()]
            empty = pa.nulls(len(langs), pa.string())
            for column in path:
                taken = column[at]
                columns.append(pa.chunked_array([words.spelt.take(pa.array(taken, mask=taken < 0)).cast(pa.string()), empty]).combine_chunks())
            columns.append(pa.array(np.concatenate([counts, totals]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _grown(longest: int, least: int):
    """Pointers in order, a prefix word's one after the other, to phrases and counts."""
    names = ["lang", *(f"w{i}" for i in range(1, longest + 1)), "f"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def grow(rows: list[tuple], depth: int, lang: str, prefix: tuple, whole: bool) -> None:
            count = sum(r[-1] for r in rows)
            if whole and count < least:
                return
            made.append((lang, *prefix, *[None] * (longest - depth), count))
            if depth == longest:
                return
            start = 0
            while start < len(rows):
                word, end = rows[start][depth], start + 1
                while end < len(rows) and rows[end][depth] == word:
                    end += 1
                if word is not None:
                    grow(rows[start:end], depth + 1, lang, (*prefix, word), whole)
                start = end

        def out() -> pa.RecordBatch:
            some = pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], pa.string() if i <= longest else pa.int64()) for i in range(longest + 2)], names=names)
            made.clear()
            return some

        now, mine = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for lang, part, parts, *row in zip(*columns, strict=True):
                if (key := (lang, part, row[0])) != now:
                    if mine:
                        grow(mine, 1, now[0], (now[2],), whole)
                    now, mine, whole = key, [], parts == 1
                    if len(made) >= 1 << 14:
                        yield out()
                mine.append(row)
        if mine:
            grow(mine, 1, now[0], (now[2],), whole)
        yield out()

    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, task: int = TASK, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, words, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n) for all words."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "phrases")
    read = spread(docs.select(F.coalesce("lang", F.lit(UND)).alias("lang"), "text"))
    hashes = scratch.cut(read.mapInArrow(_hash_counts(longest), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("h"))
    bits = spark.sparkContext.broadcast(bitmap(hashes, "h"))
    w = [f"w{i}" for i in range(1, longest + 1)]
    typed = ", ".join(f"{x} string" for x in ("lang", *w))
    pointers = scratch.cut(read.mapInArrow(_pointers(longest, bits), f"{typed}, c bigint").groupBy("lang", *w).agg(F.sum("c").alias("c")))
    totals = pointers.filter("w1 is null").groupBy("lang").agg(F.sum("c").alias("n"))
    pointers = pointers.filter("w1 is not null")
    hot = scratch.cut(pointers.groupBy("lang", "w1").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > task).select("lang", "w1", F.ceil(F.col("size") / task).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("bigint")).alias("parts")
    dealt = pointers.join(lookup(hot, 10_000), ["lang", "w1"], "left").select("lang", F.pmod(F.xxhash64(*w[1:]), parts).alias("part"), parts, *w, "c")
    dealt = dealt.repartition("lang", "w1", "part").sortWithinPartitions("lang", "part", *w)
    grown = dealt.mapInArrow(_grown(longest, least), f"{typed}, f bigint").groupBy("lang", *w).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return scratch.cut(grown.select("lang", F.array_compact(F.array(*w)).alias("words"), "f")), scratch.cut(totals)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000, task: int = TASK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of 2 to ``longest`` words of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    phrases, totals = frequent_phrases(docs, longest, least, task, scratch)
    spelt = lambda x: F.concat_ws(" ", x)
    known = phrases.select(F.col("lang").alias("k_lang"), spelt("words").alias("k"), F.col("f").alias("k_f"))
    size = F.size("words")
    found = phrases.filter(size >= 2)

    cuts = found.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", spelt("words").alias("phrase"), "a", "cut", spelt(F.expr("slice(words, 1, cut)")).alias("first"), spelt(F.expr("slice(words, cut + 1, size(words))")).alias("rest"))
    cuts = scratch.cut(cuts.join(known, (F.col("lang") == F.col("k_lang")) & (F.col("first") == F.col("k"))).select("lang", "phrase", "a", "cut", "rest", F.col("k_f").alias("l")))
    cuts = cuts.join(known, (F.col("lang") == F.col("k_lang")) & (F.col("rest") == F.col("k"))).select("lang", "phrase", "a", "cut", "l", F.col("k_f").alias("r"))
    wide = {c: f"cast({c} as decimal(20, 0))" for c in "alr"}
    score = F.expr(f"(1000000 * {wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m"))

    inner = "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> concat_ws(' ', slice(words, i, k)))))"
    over = found.filter(size >= 3).select("lang", F.explode(F.expr(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scratch.cut(scored.join(over, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "m.l", "m.r", "m.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = kept
    for salts in SALTS:
        salted = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt")
    return ranked.join(lookup(totals), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same phrases in DuckDB, for phrases of up to three words.
SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
  o AS MATERIALIZED (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w)),
  f1 AS MATERIALIZED (SELECT lang, a, count(*) AS f FROM o GROUP BY ALL),
  f2 AS MATERIALIZED (SELECT lang, a, b, count(*) AS f FROM o WHERE b IS NOT NULL GROUP BY ALL),
  f3 AS MATERIALIZED (SELECT lang, a, b, c, count(*) AS f FROM o WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
  k AS (SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b WHERE f2.f >= 10
    UNION ALL SELECT f3.lang, concat_ws(' ', f3.a, f3.b, f3.c), f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
    UNION ALL SELECT f3.lang, concat_ws(' ', f3.a, f3.b, f3.c), f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c),
  s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  h AS (SELECT lang, a || ' ' || b AS phrase, f FROM f3 UNION ALL SELECT lang, b || ' ' || c, f FROM f3),
  d AS (SELECT h.lang, h.phrase FROM h JOIN s ON s.lang = h.lang AND s.phrase = h.phrase AND 100 * h.f >= 50 * s.a),
  q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM s ANTI JOIN d USING (lang, phrase))
  SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000"""
