"""Token counts with overlap resynchronisation.

Every text is encoded in chunks of at most ``chunk`` characters with offsets;
a text that fits into one chunk needs no splice.  Neighbouring chunks overlap
and are spliced at a word boundary that both show and that is proven stable:

* Added tokens are cut out from left to right first.  A boundary at least one
  added token's length before the left chunk's end can't lie inside one.
* The pretokenizer is a scanner without memory: from a common boundary on, both
  chunks are cut alike as far as the left one reaches.  What the left chunk says
  before the boundary is final once the run at the boundary has ended in it,
  that is, a character that is no white space follows inside the chunk.
* Merges never cross pretokens, so the ids before the boundary are the left
  chunk's, and those from it on are the right chunk's.

Where the tokenizer pretokenizes at byte level, a single blank between two
characters that are no white space always is a boundary.  A chunk all of whose
blanks are such is encoded piece by piece, and a memo, bounded by bytes, keeps
the pieces' counts; the pieces' places are its offsets.  Other chunks are
encoded as a whole.

If an overlap shows no such boundary, it is widened by the factor 4, in the
worst case until the chunk begins where the left one began and takes its place.

Cases.  Null text counts as empty: no tokens.  Repeated rows give repeated
rows.  Only doc_id and text are read.  Memory is that of ``AT_ONCE`` characters'
tokens, or of the longest stretch of a text without a boundary.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import bound_batches, lean, spread
from tessera.llm.bpe import ENTRY_BYTES, SPACE

CHUNK = 16_384
OVERLAP = 512
AT_ONCE = 1 << 21
MEMO_BYTES = 96 << 20


class _Whole:
    """A chunk as the library encodes it."""

    def __init__(self, encoding):
        self.encoding, self.total = encoding, len(encoding)

    def boundaries(self, at: int, low: int, high: int) -> dict[int, int]:
        """Position in the text of each word's first token to the token's number, from ``low`` on and before ``high``.

        Offsets are trimmed or not alike in both chunks.  The first word of a
        chunk may have lost its beginning, so it is left out.
        """
        out: dict[int, int] = {}
        words, offsets = self.encoding.word_ids, self.encoding.offsets
        for i in range(max(1, bisect_left(offsets, (low - at, 0))), len(words)):
            p = at + offsets[i][0]
            if p >= high:
                break
            if words[i] != words[i - 1] and words[i - 1] is not None and words[i] is not None:
                out[p] = i
        return out


class _Pieces:
    """A chunk by the counts of its pieces."""

    def __init__(self, parts: list[str], counts: list[int], head: int):
        self.parts, self.counts, self.head = parts, counts, head
        self.total = head + sum(counts)

    def boundaries(self, at: int, low: int, high: int) -> dict[int, int]:
        out: dict[int, int] = {}
        p, number = at + len(self.parts[0]) + 1, self.head
        for part, n in zip(self.parts[1:], self.counts):
            if p >= high:
                break
            if p >= low and number:
                out[p] = number
            p += len(part) + 1
            number += n
        return out


class ChunkedCounter:
    """Counts tokens as the encoder does that ``definition``, its JSON text, describes."""

    def __init__(self, definition: str, chunk: int = CHUNK, overlap: int = OVERLAP, memo_bytes: int = MEMO_BYTES):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = max([1, *map(len, self.added)])
        self.solid = regex.compile(r"\S").search
        self.widened = 0
        self.lookahead = max(1, AT_ONCE // self.chunk)
        form = json.loads(definition)
        cut = form.get("pre_tokenizer") or {}
        self.by_piece = form.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.memo: dict[str, int | None] = {}
        self.held, self.memo_bytes = 0, memo_bytes

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Counts of pieces that follow a blank; None for those next to white space."""
        sure = [p for p in pieces if p and p[0] not in SPACE and p[-1] not in SPACE]
        self.memo.update(dict.fromkeys(pieces))
        self.memo.update(zip(sure, self._lengths([" " + p for p in sure]), strict=True))
        self.held += sum(map(len, pieces)) + ENTRY_BYTES * len(pieces)

    def _encode(self, chunks: list[str]) -> list[_Whole | _Pieces]:
        whole, parts, counts = list(range(len(chunks))), [], []
        if self.by_piece:
            if self.held > self.memo_bytes:
                self.memo, self.held = {}, 0
            parts = [c.split(" ") for c in chunks]
            tails = [p[1:] for p in parts]
            self._learn(set().union(*tails).difference(self.memo))
            counts = [list(map(self.memo.__getitem__, t)) for t in tails]
            sound = [bool(p[0]) and p[0][-1] not in SPACE and None not in n and not any(a in c for a in self.added) for c, p, n in zip(chunks, parts, counts, strict=True)]
            whole = [i for i, s in enumerate(sound) if not s]
        out: list[_Whole | _Pieces] = [None] * len(chunks)  # type: ignore[list-item]
        for i, e in zip(whole, self.tokenizer.encode_batch([chunks[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = _Whole(e)
        rest = [i for i, e in enumerate(out) if e is None]
        for i, n in zip(rest, self._lengths([parts[i][0] for i in rest]), strict=True):
            out[i] = _Pieces(parts[i], counts[i], n)
        return out

    def _splice(self, text: str, left, left_at: int, left_end: int, right, right_at: int) -> tuple[int, int] | None:
        """Numbers of the first token after the splice, in the left and in the right chunk."""
        mine, theirs = (e.boundaries(at, right_at, left_end) for e, at in ((left, left_at), (right, right_at)))
        for p in sorted(mine.keys() & theirs.keys(), reverse=True):
            if p + self.margin <= left_end and p > right_at + self.margin and self.solid(text, p, left_end - 1):
                return mine[p], theirs[p]
        return None

    def count(self, text: str, first=None) -> int:
        """``first``: the encoding of the first chunk, if it is there already."""
        left = first or self._encode([text[: self.chunk]])[0]
        total, at, end, begin = 0, 0, min(self.chunk, len(text)), 0  # begin: the left chunk's first token that isn't counted yet
        ready: dict[tuple[int, int], object] = {}
        while end < len(text):
            overlap = self.overlap
            while True:
                right_at = max(at, end - overlap)
                right_end = min(len(text), max(end - self.overlap + self.chunk, right_at + 2 * overlap))
                if (right_at, right_end) not in ready:
                    ready = self._chunks(text, right_at, right_end, 1 if overlap > self.overlap else self.lookahead)
                right = ready[right_at, right_end]
                if right_at == at:  # it begins as the left chunk does, so what was spliced there stays valid
                    found = begin, begin
                    break
                found = self._splice(text, left, at, end, right, right_at)
                if found and found[0] >= begin:
                    break
                self.widened += 1
                overlap *= 4
            total += found[0] - begin
            left, begin, at, end = right, found[1], right_at, right_end
        return total + left.total - begin

    def _chunks(self, text: str, at: int, end: int, most: int) -> dict[tuple[int, int], object]:
        """The chunk from ``at`` to ``end`` and those that follow it if no overlap is widened."""
        spans = [(at, end)]
        while len(spans) < most and spans[-1][1] < len(text):
            at = max(spans[-1][0], spans[-1][1] - self.overlap)
            spans.append((at, min(len(text), max(at + self.chunk, at + 2 * self.overlap))))
        return dict(zip(spans, self._encode([text[a:b] for a, b in spans]), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        group: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(t)
            size += min(len(t), self.chunk)
            if size > AT_ONCE or i + 1 == len(texts):
                out += map(self.count, group, self._encode([x[: self.chunk] for x in group]))
                group, size = [], 0
        return out


_COUNTERS: dict[tuple, ChunkedCounter] = {}


def _counter(definition: str, chunk: int, overlap: int) -> ChunkedCounter:
    """One counter for each worker and vocabulary."""
    key = hash(definition), chunk, overlap
    if key not in _COUNTERS:
        _COUNTERS[key] = ChunkedCounter(definition, chunk, overlap)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``path`` names the tokenizer's JSON file."""
    bound_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(definition.value, chunk, overlap)
        for batch in lean(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = spread(docs).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
