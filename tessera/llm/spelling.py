"""Spelling variants grouped by full neighbourhood generation.

1. Each text's runs of letters become words by ``Runs`` (lower-cased, some of
   them with a letter deleted by a hash), counted in the tasks and summed.
   Words that are long and frequent enough are the vocabulary.
2. Every vocabulary word makes all its distinct deletions, replacements and
   insertions over the letters that the vocabulary uses.  A candidate's hash
   is a sum of one random number for each place and letter, so it follows
   from the word's running sums by one addition, and only candidates whose
   hash is in the vocabulary's bitmap (of bounded size, without misses) are
   spelled out.
3. An equality join of candidates with the vocabulary gives the near words.
   No distance is computed: what was generated is near.
4. A word's form is its near word of largest count, if that is ``ratio`` times
   its own; roots follow from doubling the forms' steps.

A word has at most two neighbours for each letter and place, so no group in
the joins is large.  Counts along forms grow by ``ratio`` each step, so chains
are short and cycles don't exist.

Cases.  Null and empty texts have no words.  A null doc_id hashes as an empty
string.  Rows that repeat count again.  Long texts are read in pieces, cut
between runs; a run is one word however long it is, its candidates are made
some at a time.  An empty table gives no rows.  Columns other than doc_id and
text aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._bloom import bitmap, holds
from tessera.llm._store import Scratch, bound_batches, lean, spread

#: UTF-8 of A-Z, a-z and U+00C0 to U+00FF, whose first byte no other code point has.
RUN = re.compile(rb"(?:[A-Za-z]+|\xC3[\x80-\xBF])+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTED = 1 << 17  # words counted in a task before they go to Spark
CHUNK = 1 << 20
AT_ONCE = 1 << 20  # candidates hashed at a time


def chunks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes, never cut within a run."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while text[cut] & 0xC0 == 0x80:
            cut -= 1
        run = RUN.match(text, cut)
        cut = run.end() if run else cut
        yield text[start:cut]
        start = cut
    yield text[start:]


def _letters(word: bytes) -> list[bytes]:
    return [c.encode() for c in word.decode()]


def misspelt(word: bytes, h: int) -> bytes:
    """Without its code point number h % length."""
    letters = _letters(word)
    del letters[h % len(letters)]
    return b"".join(letters)


def _counts(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = zlib.crc32
        held: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in lean(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                start = crc(f"{doc_id or ''}:".encode())
                for piece in chunks((text.as_py() or b"").translate(LOWER)):
                    words = RUN.findall(piece)
                    held.update(words)
                    for word in words:
                        if (h := crc(word, start)) % every == 0:
                            held[word] -= 1
                            held[misspelt(word, h)] += 1
                    if len(held) >= COUNTED:
                        yield made()
        yield made()

    return run


def word_counts(docs: DataFrame, every: int = 199) -> DataFrame:
    """(word, n): how often each word occurs; a run is misspelt if ``every`` divides crc32 of "doc_id:run"."""
    read = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return read.mapInArrow(_counts(every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _worth(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The random number of a letter at a place."""
    return _mixed((place.astype(np.uint64) << np.uint64(21) | letter.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """Of words of one length, a row of code points each."""
    return _worth(np.arange(points.shape[1])[None, :], points).sum(1, dtype=np.uint64)


def _sums(worth: np.ndarray, back: bool) -> np.ndarray:
    """Running sums of rows, from the left or from the right, beginning with 0."""
    m, n = worth.shape
    out = np.zeros((m, n + 1), np.uint64)
    if back:
        out[:, :n] = np.cumsum(worth[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    else:
        out[:, 1:] = np.cumsum(worth, axis=1, dtype=np.uint64)
    return out


def neighbours(points: np.ndarray, alphabet: np.ndarray, passes) -> Iterator[tuple[int, str]]:
    """Row and spelling of the distinct words at one deletion, replacement or insertion whose hash ``passes`` lets through; all words have one length.

    A letter of a run of equal ones is deleted once; nothing is inserted before
    its equal.  So every candidate is made once.
    """
    m, n = points.shape
    spelt = lambda *parts: np.concatenate(parts).astype(np.uint32).tobytes().decode("utf-32-le")
    place = np.arange(n)[None, :]
    here = _worth(place, points)
    total = here.sum(1, dtype=np.uint64)
    before = _sums(here, False)
    down = _sums(_worth(np.maximum(place, 1) - 1, points), True)  # letters from i, each one place down
    up = _sums(_worth(place + 1, points), True)  # letters from i, each one place up
    row, i = np.nonzero(np.concatenate([points[:, :-1] != points[:, 1:], np.ones((m, 1), bool)], 1))
    for k in np.flatnonzero(passes(before[row, i] + down[row, i + 1])):
        yield int(row[k]), spelt(points[row[k], : i[k]], points[row[k], i[k] + 1 :])
    step = max(1, AT_ONCE // max(1, m * len(alphabet)))
    for a in range(0, n + 1, step):
        at = np.arange(a, min(n + 1, a + step))
        worth = _worth(at[:, None], alphabet[None, :])
        now = np.full((m, len(at)), 0xFFFFFFFF, np.uint32)  # no letter
        inner = at < n
        now[:, inner] = points[:, at[inner]]
        row, i, c = np.nonzero(now[:, :, None] != alphabet[None, None, :])
        place_of = at[i]
        for k in np.flatnonzero(passes(before[row, place_of] + worth[i, c] + up[row, place_of])):
            word, x = points[row[k]], place_of[k]
            yield int(row[k]), spelt(word[:x], alphabet[c[k] : c[k] + 1], word[x:])
        some = inner[i]
        row, i, c, place_of = row[some], i[some], c[some], place_of[some]
        for k in np.flatnonzero(passes(total[row] - here[row, place_of] + worth[i, c])):
            word, x = points[row[k]], place_of[k]
            yield int(row[k]), spelt(word[:x], alphabet[c[k] : c[k] + 1], word[x + 1 :])


def _blocks(words: list[str], letters: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of one length, as many at a time as ``AT_ONCE`` candidates allow."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        n = len(words[order[start]])
        most = max(1, AT_ONCE // ((n + 1) * max(1, letters)))
        mine = [i for i in order[start : start + most] if len(words[i]) == n]
        yield mine, np.stack([_points(words[i]) for i in mine])
        start += len(mine)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, points in _blocks(batch.column(0).to_pylist(), 1):
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(points).view(np.int64))], names=["h"])


def _candidates(alphabet: list[str], bits):
    letters = np.array([ord(c) for c in alphabet], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        passes = lambda h: holds(known, h)

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["candidate", "of", "of_n"])

        rows: list[tuple[str, str, int]] = []
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for mine, points in _blocks(words, len(letters)):
                for row, candidate in neighbours(points, letters, passes):
                    rows.append((candidate, words[mine[row]], counts[mine[row]]))
                    if len(rows) >= 1 << 14:
                        yield made(rows)
                        rows = []
        yield made(rows)

    return run


def near_words(vocabulary: DataFrame, alphabet: list[str]) -> DataFrame:
    """(of, of_n, word, n): each word of the vocabulary with each near word of it; ``vocabulary`` is a written table (word, n) of distinct words."""
    spark = vocabulary.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(vocabulary.select("word").mapInArrow(_hashes, "h bigint"), "h"))
    dealt = vocabulary.select("word", "n").repartition(4 * spark.sparkContext.defaultParallelism)
    made = dealt.mapInArrow(_candidates(alphabet, bits), "candidate string, of string, of_n bigint")
    return made.join(vocabulary.select("word", "n"), F.col("candidate") == F.col("word")).select("of", "of_n", "word", "n")


def spelling_groups(docs: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """One row for each word of the vocabulary: word, form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "spelling")
    vocabulary = scratch.cut(word_counts(docs, every).filter((F.col("n") >= least_count) & (F.char_length("word") >= least_letters)))
    # The alphabet has 116 letters at most, by the pattern of runs.
    alphabet = sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", ""))).distinct().collect() if r[0])
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")))
    near = near_words(vocabulary, alphabet).groupBy(F.col("of").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.first("of_n").alias("n"), best.alias("best"))
    formed = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    near = scratch.cut(near.select("word", "n_near", formed["form"].alias("form"), (-formed["less"]).alias("form_n")))

    steps = scratch.cut(near.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")).filter("root is not null"))
    while not steps.filter("moved").isEmpty():
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.cut(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(steps)
        steps = further
    out = vocabulary.join(near, "word", "left").join(steps.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


#: The same groups in DuckDB; crc32 by its table of 256 values.
SQL = r"""WITH RECURSIVE byte AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM byte WHERE k < 8),
  crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM byte WHERE k = 8),
  o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  u AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM o GROUP BY ALL),
  x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hexed FROM u),
  h AS MATERIALIZED (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, len(hexed) // 2), lambda i: ('0x' || hexed[2 * i - 1 : 2 * i])::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM x, crc),
  m AS (SELECT CASE WHEN h % 199 = 0 THEN run[: h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, n FROM h),
  v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m GROUP BY word HAVING sum(n) >= 5 AND len(word) >= 6),
  p AS MATERIALIZED (SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS b FROM (SELECT word, n, unnest(generate_series(1, len(word))) AS i FROM v)),
  e AS (SELECT x.word, y.word AS other FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT p.word, v.word FROM p JOIN v ON v.word = p.a || p.b UNION SELECT v.word, p.word FROM p JOIN v ON v.word = p.a || p.b),
  g AS (SELECT e.word, count(*) AS n_near, arg_min(other, (-y.n, other)) AS form, max(y.n) AS form_n, any_value(x.n) AS n FROM e JOIN v x ON x.word = e.word JOIN v y ON y.word = other GROUP BY e.word),
  f AS MATERIALIZED (SELECT word, form, form_n FROM g WHERE form_n >= 5 * n),
  r(word, root) AS (SELECT word, form FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root),
  z AS (SELECT word, root FROM r WHERE root NOT IN (SELECT word FROM f))
  SELECT v.word, f.form, coalesce(z.root, v.word) AS root, v.n, coalesce(g.n_near, 0) AS n_near, f.form_n FROM v LEFT JOIN g ON g.word = v.word LEFT JOIN f ON f.word = v.word LEFT JOIN z ON z.word = v.word"""
