"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

For each pretoken a segment tree stands over its adjacent pairs; a leaf holds
(rank of the pair, position), a node the minimum of its children.  The root is
the leftmost pair of the lowest rank.  Merging it changes three leaves, so each
merge costs a logarithmic number of node updates, until the root says that no
pair can merge.  ``SegmentTreeBpe.encode_many`` does this for many pretokens at
once: the trees of pretokens of one size class lie side by side in one array,
and every step merges once in each of them, until only a few still can; these
are finished one by one, so a pretoken of any length costs a logarithmic number
of plain steps a merge.

Texts are cut at single blanks between two characters that are no white space.
There the pretokenizer always has a boundary: what precedes is a run that
cannot hold a blank, and a pretoken that begins with a blank takes the next
character along.  The pieces repeat, so a bounded memo keeps their ids; each
is decoded when it is learnt, and pieces that don't decode to themselves are
noted, so a text is decoded by joining what its pieces decode to.

Cases.  Null text counts as empty and has no ids.  Strings of added tokens
inside texts become their ids, as the library does by default.  Very long
texts and pretokens need memory in proportion to their length.  Repeated rows
give repeated rows.  Only doc_id and text are read.  A vocabulary of another
form than byte-level BPE with the pretokenizer below is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import bound_batches, lean, spread

# The pretokenizer's pattern and the white space it knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

MEMO_BYTES = 32 << 20
ENTRY_BYTES = 200  # what an entry costs beside its texts
FEW = 24  # trees; fewer are finished one by one
DOCS_AT_ONCE = 512
PRETOKENS_AT_ONCE = 20_000


def byte_symbols() -> dict[int, str]:
    """The printable symbol for each byte in the vocabulary's spelling."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def check_form(data: dict) -> None:
    """Raises unless the file describes what this module computes."""
    model, cut, back = data.get("model") or {}, data.get("pre_tokenizer") or {}, data.get("decoder") or {}
    wrong = [f"{k} of the model" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["model"] if model.get("type", "BPE") != "BPE" else []
    wrong += ["normalizer"] if data.get("normalizer") else []
    wrong += ["pre_tokenizer"] if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space", True) or not cut.get("use_regex", True) else []
    wrong += ["decoder"] if back.get("type") != "ByteLevel" else []
    wrong += [f"added token {t['content']}" for t in data.get("added_tokens") or [] if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    if wrong:
        raise ValueError("unsupported in this vocabulary: " + ", ".join(wrong))


class SegmentTreeBpe:
    """A byte-level BPE vocabulary; ``definition`` is the text of its JSON file."""

    def __init__(self, definition: str):
        import regex

        data = json.loads(definition)
        check_form(data)
        vocab: dict[str, int] = data["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in symbols.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged_list = self.merged.tolist()
        self.rank_by_pair = dict(zip(pairs.tolist(), range(len(pairs))))
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.added_bytes = [t.encode() for t in self.added]
        self.token_bytes: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.token_bytes |= {i: t.encode() for t, i in self.added.items()}
        self.find = regex.compile(PATTERN).findall
        self.no_rank = len(merges)
        two = (self.byte_id[:, None].astype(np.int64) << 20) | self.byte_id[None, :]
        self.byte_pair_rank = self.rank_of(two.ravel())

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], self.no_rank)

    def encode_many(self, pretokens: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each pretoken."""
        size = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        start = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(pretokens), np.uint8)
        count = np.zeros(len(pretokens), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        width = 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            step = max(1, (PRETOKENS_AT_ONCE * 16) // w)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                ids, n = self._merge(data, start[part], size[part], w)
                count[part] = n
                found.append((part, ids))
        out = np.empty(int(count.sum()), np.int32)
        to = np.concatenate([[0], np.cumsum(count)])
        for part, ids in found:
            n = count[part]
            out[np.repeat(to[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(ids))] = ids
        return out, count

    def _merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Segment trees of ``width`` leaves, side by side."""
        n, bits = len(start), max(16, int(width).bit_length())
        kind = np.uint32 if bits == 16 and self.no_rank < (1 << 16) - 1 else np.uint64
        none = np.iinfo(kind).max
        column = np.arange(width)
        inside = column[None, :] < size[:, None]
        raw = data[np.where(inside, start[:, None] + column, 0)] if len(data) else np.zeros((n, width), np.uint8)
        ids = np.full((n, width + 1), 0, np.int32)
        ids[:, :width] = self.byte_id[raw]
        rank = self.byte_pair_rank[(raw[:, :-1].astype(np.int32) << 8) | raw[:, 1:]]
        tree = np.full((n, 2 * width), none, kind)
        pair_here = inside[:, 1:] & (rank < self.no_rank)
        tree[:, width : 2 * width - 1] = np.where(pair_here, (rank.astype(kind) << kind(bits)) | column[:-1].astype(kind), none)
        at = width
        while at > 1:
            np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2], out=tree[:, at // 2 : at])
            at //= 2
        after = np.empty((n, width + 1), np.int32)
        after[:, :] = np.arange(1, width + 2)
        after[np.arange(n), size - 1] = width
        before = np.empty((n, width + 1), np.int32)
        before[:, :] = np.arange(-1, width)
        alive = inside.copy()
        flat, ids_f, after_f, before_f, alive_f = tree.ravel(), ids.ravel(), after.ravel(), before.ravel(), alive.ravel()
        live = np.arange(n)
        low = kind((1 << bits) - 1)
        while True:
            root = flat[live * (2 * width) + 1]
            more = root != none
            live, root = live[more], root[more]
            if len(live) < FEW:
                for r in live.tolist():
                    self._finish(tree[r], ids[r], after[r], before[r], alive[r], bits, int(none))
                break
            left = (root & low).astype(np.int64)
            new = self.merged[(root >> kind(bits)).astype(np.int64)]
            row = live * (width + 1)
            right = after_f[row + left].astype(np.int64)
            third = after_f[row + right].astype(np.int64)
            ids_f[row + left] = new
            after_f[row + left] = third
            before_f[row + third] = left  # the slot behind the last one takes what has no successor
            alive_f[live * width + right] = False
            first = before_f[row + left].astype(np.int64)
            # The pair (left, third), the pair that is gone, and (first, left).
            key = np.concatenate([(new.astype(np.int64) << 20) | ids_f[row + third], (ids_f[row + np.maximum(first, 0)].astype(np.int64) << 20) | new])
            ranks = self.rank_of(key)
            m = len(live)
            base = live * (2 * width) + width
            value = (ranks.astype(kind) << kind(bits)) | np.concatenate([left, np.maximum(first, 0)]).astype(kind)
            flat[base + right] = none
            flat[base + left] = np.where((third < width) & (ranks[:m] < self.no_rank), value[:m], none)
            has = first >= 0
            flat[(base + first)[has]] = np.where(ranks[m:] < self.no_rank, value[m:], none)[has]
            tree_at = live * (2 * width)
            a, b, c = left + width, right + width, np.maximum(first, 0) + width
            while True:
                a, b, c = a >> 1, b >> 1, c >> 1
                for x in (a, b, c):
                    two = tree_at + 2 * x
                    flat[tree_at + x] = np.minimum(flat[two], flat[two + 1])
                if a[0] == 1:
                    break
        return ids[:, :width][alive], alive.sum(1)


    def _finish(self, tree, ids, after, before, alive, bits: int, none: int) -> None:
        """The remaining merges of one pretoken; the rows of ``_merge`` are changed in place."""
        width, low, merged, rank_of = len(alive), (1 << bits) - 1, self.merged_list, self.rank_by_pair.get
        nodes, mine, following, previous, gone = tree.tolist(), ids.tolist(), after.tolist(), before.tolist(), []

        def put(at: int, value: int) -> None:
            at += width
            nodes[at] = value
            while at > 1:
                least = min(nodes[at], nodes[at ^ 1])
                at >>= 1
                if nodes[at] == least:
                    return
                nodes[at] = least

        def leaf(left: int, right: int) -> int:
            rank = rank_of((mine[left] << 20) | mine[right])
            return none if rank is None else rank << bits | left

        while (root := nodes[1]) != none:
            left = root & low
            right = following[left]
            third, first = following[right], previous[left]
            mine[left] = merged[root >> bits]
            following[left] = third
            previous[third] = left
            gone.append(right)
            put(right, none)
            put(left, leaf(left, third) if third < width else none)
            if first >= 0:
                put(first, leaf(first, left))
        ids[:] = mine
        alive[gone] = False


class PieceCoder:
    """Encodes and decodes texts by their pieces; ids as decimal text.  The memo is emptied beyond ``most`` bytes."""

    def __init__(self, bpe: SegmentTreeBpe, most: int = MEMO_BYTES):
        self.bpe, self.most, self.held = bpe, most, 0
        self.id_text = {i: str(i).encode() for i in bpe.token_bytes}
        self.ids: dict[bytes, bytes | None] = {}
        self.other: dict[bytes, bytes] = {}  # what pieces decode to that don't decode to themselves

    def _learn(self, pieces: set[bytes], heads: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Memorise pieces that follow a blank; None for those next to white space.

        Returns what begins a text, coded; without what ends in white space.
        """
        todo: list[bytes] = []
        counts: list[int] = []
        plain: list[bytes] = []
        for piece in pieces:
            text = piece.decode("utf-8", "surrogatepass")
            if not text or text[0] in SPACE or text[-1] in SPACE:
                self.ids[piece] = None
                self.held += len(piece) + ENTRY_BYTES
                continue
            plain.append(piece)
            if text.isalpha():
                todo.append(b" " + piece)
                counts.append(1)
            else:
                found = self.bpe.find(" " + text)
                todo += [x.encode("utf-8", "surrogatepass") for x in found]
                counts.append(len(found))
        begin: list[bytes] = []
        for head in heads:
            text = head.decode("utf-8", "surrogatepass")
            if text and text[-1] not in SPACE:
                found = self.bpe.find(text)
                todo += [x.encode("utf-8", "surrogatepass") for x in found]
                counts.append(len(found))
                begin.append(head)
        coded = self._coded(todo, counts)
        for piece in plain:
            self.ids[piece], back = ids, _ = next(coded)
            self.held += len(piece) + len(ids) + ENTRY_BYTES
            if back != b" " + piece:
                self.other[piece] = back
                self.held += len(back) + ENTRY_BYTES
        return dict(zip(begin, coded, strict=True))

    def _coded(self, pretokens: list[bytes], counts: list[int]) -> Iterator[tuple[bytes, bytes]]:
        """For each run of ``counts`` pretokens: its ids as text, and its ids decoded."""
        if not pretokens:
            yield from ((b"", b"") for _ in counts)
            return
        ids, n = self.bpe.encode_many(pretokens)
        flat = ids.tolist()
        to = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        text, back = self.id_text.__getitem__, self.bpe.token_bytes.__getitem__
        for a, b in zip(to, to[1:]):
            mine = flat[a:b]
            yield b",".join(map(text, mine)), b"".join(map(back, mine))

    def _segment(self, text: bytes) -> tuple[bytes, bytes]:
        """A text without added tokens, pretokenized as a whole."""
        found = [x.encode("utf-8", "surrogatepass") for x in self.bpe.find(text.decode("utf-8", "surrogatepass"))]
        return next(iter(self._coded(found, [len(found)])))

    def code(self, texts: Sequence[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids joined by commas, decoded bytes) of each text."""
        parts = [t.split(b" ") for t in texts]
        if self.held > self.most:
            self.ids, self.other, self.held = {}, {}, 0
        tails = [p[1:] for p in parts]
        heads = self._learn(set().union(*tails).difference(self.ids), {p[0] for p in parts if len(p) > 1})
        for text, pieces, tail in zip(texts, parts, tails, strict=True):
            yield self._code(text, heads.get(pieces[0]), tail)

    def _code(self, text: bytes, head: tuple[bytes, bytes] | None, tail: list[bytes]) -> tuple[bytes, bytes]:
        if any(a in text for a in self.bpe.added_bytes):
            ids, back = [], []
            for segment in self.bpe.added_split.split(text.decode("utf-8", "surrogatepass")):
                if segment in self.bpe.added:
                    ids.append(self.id_text[self.bpe.added[segment]])
                    back.append(segment.encode())
                elif segment:
                    a, b = self._segment(segment.encode("utf-8", "surrogatepass"))
                    ids.append(a)
                    back.append(b)
            return b",".join(ids), b"".join(back)
        if not head or not tail:
            return self._segment(text)
        ids = list(map(self.ids.__getitem__, tail))
        if None in ids:  # white space meets a blank, so no boundary is certain there
            return self._segment(text)
        ids.insert(0, head[0])
        back = b" ".join([head[1], *tail]) if not self.other else b"".join([head[1], *(self.other.get(p, b" " + p) for p in tail)])
        return b",".join(ids), back


_CODERS: dict[int, PieceCoder] = {}


def _coder(definition) -> PieceCoder:
    """One coder for each worker and vocabulary."""
    key = hash(definition.value)
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(SegmentTreeBpe(definition.value))
    return _CODERS[key]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids and decoded.

    ``path`` names the vocabulary's JSON file; its text is sent to the workers.
    """
    bound_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        coder = _coder(definition)
        for batch in lean(batches):
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                n, ids_sha, back_sha, ids, backs = [], [], [], [], []
                for joined, back in coder.code(texts):
                    n.append(joined.count(b",") + 1 if joined else 0)
                    text = back.decode("utf-8", "replace")
                    ids_sha.append(sha256(joined).hexdigest())
                    back_sha.append(sha256(text.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.array(joined.split(b","), np.int32) if joined else np.empty(0, np.int32))
                        backs.append(text)
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(backs, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return spread(docs).select("doc_id", "text").mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))


def decode_ids(ids: Sequence[int], bpe: SegmentTreeBpe) -> str:
    return b"".join(map(bpe.token_bytes.__getitem__, ids)).decode("utf-8", "replace")
