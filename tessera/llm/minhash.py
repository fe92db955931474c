"""MinHash near-dedup with b-bit signatures.

1. Each text becomes its set of hashed word shingles, the minima of the set
   under a family of hash functions, the keys of bands of those minima, and a
   packed signature of the low 4 bits of every minimum.
2. Texts with one and the same set form a class; all further work is on
   classes, so copies cost nothing.
3. Band buckets name candidates.  Every member of a bucket is paired with two
   members that a hash draws for the bucket (never with all others), pairs are
   filtered by the similarity estimated from the signatures, corrected for
   chance agreement of low bits, and by parity bitmaps, and confirmed on the
   full sets.
4. Links are contracted to components.  Buckets whose members now lie in one
   component need no more pairs.  In each of the rest the members outside the
   bucket's largest component meet every member of another component, and the
   pairs that pass both filters are confirmed: so each pair of classes that
   share a bucket is linked, in one component, or tested.  Buckets in which that
   would be more than ``COMPARED`` comparisons are searched by prefixes instead:
   shingles are ordered by how many sets of such buckets have them, the rarest
   first, and only sets that share one of their first n - ceil(t n) + 1 shingles
   can have similarity t, so nothing is lost and common shingles pair no one.

A parity bitmap has a bit for each of 1024 cells: whether the set has an odd
number of hashes there.  Sets differ in at least as many hashes as their
bitmaps in bits, which is an upper bound of their similarity.

The number of bands makes a pair at the threshold share no bucket with
probability ``MISS`` at most; the estimate's margin is 5.5 deviations.

Cases.  Null, empty or blank text has an empty set and is linked with nothing.
Texts with fewer words than a shingle have their whole sequence as one.  Rows
that repeat a doc_id are texts of their own: each gets the component of its
text, and equal rows are kept or not alike; a component's id is its smallest
non-null doc_id.
A row with null doc_id gets its component's id and is never kept unless it has
no other.  A very long text is read piece by piece and has its whole set, at
about eight bytes a word several times over.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import Scratch, bound_batches, lean, spread

ROWS = 5
MISS = 1e-6
SIGNATURE = 128  # minima kept with LOW_BITS bits each
LOW_BITS = 4
LONGS = SIGNATURE * LOW_BITS // 64
CELLS = 1024
SLICE_BYTES = 1 << 20
MINIMA_AT_ONCE = 2048
COMPARED = 1 << 14
_BLANK = re.compile(rb"[ \t-\r]")
BROADCAST_BYTES = 48 << 20
ID_BYTES = 40  # of a row with two hashes, beside its id


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return max(math.ceil(SIGNATURE / rows), math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)))


def least_estimate(percent: int) -> float:
    t, chance = percent / 100, 2.0**-LOW_BITS
    f = chance + (1 - chance) * t
    return t - 5.5 * math.sqrt(f * (1 - f) / SIGNATURE) / (1 - chance)


class Shingler:
    """Distinct hashed word shingles of texts, many texts at a time.

    A word's hash is XXH3 of its bytes, taken once for each different word of a
    slice; a shingle's hash mixes those of its words.
    """

    def __init__(self, words: int):
        import numpy as np

        self.np, self.words = np, words
        rng = np.random.default_rng(20240229)
        self.place = rng.integers(1, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.low = np.arange(256, dtype=np.uint8)
        self.low[65:91] += 32

    def mixed(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def hashed(self, data: bytes):
        """(first, hash) of each word: where it starts, and its hash."""
        import xxhash

        np = self.np
        data = self.low[np.frombuffer(data, np.uint8)]
        blank = self.blank[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))  # word starts and ends in turn
        first, last = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
        spelt = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
        known = np.array([xxhash.xxh3_64_intdigest(w) for w in spelt.dictionary.to_pylist()], np.uint64)
        return first, known[spelt.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)

    def _long(self, text: bytes):
        """Hashes of a long text's words, read piece by piece, cut at blanks."""
        parts, start = [], 0
        while start < len(text):
            found = _BLANK.search(text, start + SLICE_BYTES)
            end = found.start() if found else len(text)
            parts.append(self.hashed(text[start:end])[1])
            start = end
        return self.np.concatenate(parts)

    def sets(self, texts: list[bytes]) -> list:
        """A sorted array of distinct hashes for each text."""
        np, k = self.np, self.words
        if len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES:
            word = self._long(texts[0])
            at = np.array([0, len(word)])
        else:
            first, word = self.hashed(b"\n".join(texts))
            at = np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in texts)]))  # words of text i: at[i] to at[i + 1]
        n = len(word)
        rolled = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            rolled += word[j : n - k + 1 + j] * self.place[j] if n >= k else rolled
        rolled = self.mixed(rolled)
        out = []
        for a, b in zip(at.tolist(), at[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                short = (word[a:b] * self.place[: b - a]).sum(dtype=np.uint64) + np.uint64(0x1234567 * (b - a))
                out.append(self.mixed(np.array([short], np.uint64)))
            else:
                out.append(rolled[:0])
        return out


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        shingler = Shingler(words)
        rng = np.random.default_rng(7)
        count = max(bands * rows, SIGNATURE)
        factor = (rng.integers(1, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        extra = rng.integers(1, 1 << 32, count, dtype=np.uint32)[:, None]
        weight = rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(1, 1 << 63, bands, dtype=np.uint64)
        shift = (np.arange(64 // LOW_BITS, dtype=np.uint64) * np.uint64(LOW_BITS))[None, None, :]

        def minima(x):
            x = (x >> np.uint64(32)).astype(np.uint32)[None, :]
            y = x * factor + extra
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            return y.min(axis=1)

        for batch in lean(batches):
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            for a, b in _slices(texts):
                sets = shingler.sets(texts[a:b])
                low = np.full((b - a, count), np.iinfo(np.uint32).max, np.uint32)
                for i, x in enumerate(sets):
                    for k in range(0, len(x), MINIMA_AT_ONCE):
                        np.minimum(low[i], minima(x[k : k + MINIMA_AT_ONCE]), out=low[i])
                keys = shingler.mixed((low[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64) * weight).sum(2, dtype=np.uint64) + salt)
                few = low[:, :SIGNATURE].astype(np.uint64) & np.uint64((1 << LOW_BITS) - 1)
                packed = np.bitwise_or.reduce(few.reshape(-1, LONGS, 64 // LOW_BITS) << shift, axis=2)
                odd = np.zeros((b - a, CELLS), np.uint8)
                for i, x in enumerate(sets):
                    odd[i] = np.bincount((x & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
                parity = np.packbits(odd, axis=1).view(np.uint64)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.view(np.int64).ravel()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) if len(x) else None for x in sets], pa.binary()), lists(keys), lists(packed), lists(parity)],
                    names=["doc_id", "row_key", "n_shingles", "cls", "bands", "sig", "parity"],
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        shingler = Shingler(words)
        for batch in lean(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _slices(texts):
                sets = shingler.sets(texts[a:b])
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["nid", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in lean(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def estimated(x: Column, y: Column) -> Column:
    """Similarity from packed signatures: share of equal low-bit fields, less the agreement by chance."""
    fields = F.lit(sum(1 << i for i in range(0, 64, LOW_BITS)))
    unequal = None
    for i in range(LONGS):
        d = x[i].bitwiseXOR(y[i])
        for k in (1, 2):  # every field's bits meet in its lowest
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        n = F.bit_count(d.bitwiseAND(fields))
        unequal = n if unequal is None else unequal + n
    chance = 2.0**-LOW_BITS
    return ((1.0 - unequal / F.lit(float(SIGNATURE))) - chance) / (1.0 - chance)


def possible(percent: int) -> Column:
    """Whether pair (a, b) can be a link: by the estimate, and for certain by the parity bitmaps."""
    unequal = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(1, CELLS // 64)), F.bit_count(F.col("parity_a")[0].bitwiseXOR(F.col("parity_b")[0])))
    near = unequal * (100 + percent) <= (F.col("n_shingles_a") + F.col("n_shingles_b")) * (100 - percent)
    return near & (estimated(F.col("sig_a"), F.col("sig_b")) >= least_estimate(percent))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node with an edge down has one, to a node without."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links to (nid, root), for every nid that isn't a root itself.

    Alternating star contractions: each node hands its larger neighbours to the
    smallest one, then its smaller ones, until the edges are stars.
    """
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select("u", F.col("m").alias("v")).unionByName(near.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct()
        new = scratch.cut(small)
        scratch.drop(edges)
        edges = new
    return edges.select(F.col("u").alias("nid"), F.col("v").alias("root"))


def _share_prefix(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(nid, root) to the pairs (a, b) of other roots that share a shingle among their rarest, early enough in both.

    The first shared shingle, at places i and j, leaves 1 + min(n_a - i, n_b - j)
    shared ones at most; a link needs t / (1 + t) (n_a + n_b).
    """
    placed = scratch.cut(members.join(sets, "nid").select("nid", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    used = scratch.cut(placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses")))
    ranked = placed.join(used, "shingle").groupBy("nid", "root", "n").agg(F.array_sort(F.collect_list(F.struct("uses", "shingle"))).alias("rarest"))
    prefix = F.slice("rarest", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    shown = ranked.select("nid", "root", "n", F.posexplode(prefix).alias("place", "s")).filter("s.uses > 1").select("nid", "root", "n", "place", F.col("s.shingle").alias("shingle"))
    shown = scratch.cut(shown)
    x, y = (shown.select(F.col("shingle").alias(f"shingle_{c}"), F.col("nid").alias(c), F.col("root").alias(f"root_{c}"), F.col("n").alias(f"n_{c}"), F.col("place").alias(f"place_{c}")) for c in "ab")
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # places count from 0
    enough = left * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    alike = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("a") < F.col("b"))
    return x.join(y, (F.col("shingle_a") == F.col("shingle_b")) & alike & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, broadcast_bytes: int = BROADCAST_BYTES, compared: int = COMPARED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, n_shingles, component_id, kept.

    Ids of texts whose full sets are needed are broadcast if they have at most
    ``broadcast_bytes``, else shuffled.  ``row_key`` is xxhash64(text).  Links: 100 * |intersection| >= percent * |union|.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "minhash")
    bands = band_count(percent)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = spread(docs).select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    signed = scratch.cut(keyed.mapInArrow(_signatures(words, bands, ROWS), f"doc_id {id_type}, row_key bigint, n_shingles bigint, cls binary, bands array<bigint>, sig array<bigint>, parity array<bigint>"))
    first = F.min(F.struct("doc_id", "row_key", "n_shingles", "bands", "sig", "parity")).alias("m")
    classes = scratch.cut(
        signed.filter("cls is not null").groupBy("cls").agg(first, F.min("doc_id").alias("low"))
        .select(F.monotonically_increasing_id().alias("nid"), "cls", "low", "m.doc_id", "m.row_key", "m.n_shingles", "m.bands", "m.sig", "m.parity")
    )
    member = classes.select("nid", F.explode("bands").alias("bucket"))
    drawn = F.col("nid").bitwiseXOR(F.col("bucket"))  # in an order of its own in each bucket, and nid can be had back
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(drawn).alias("lo"), F.max(drawn).alias("hi")).filter("n > 1")
    # A table, so that the join below shuffles both sides and a large bucket can be split.
    shared = scratch.cut(shared.select("bucket", "n", *[F.col(c).bitwiseXOR(F.col("bucket")).alias(c) for c in ("lo", "hi")]))
    member = scratch.cut(member.join(shared, "bucket"))
    pairs = member.select("nid", F.explode(F.array("lo", "hi")).alias("p")).filter("nid != p").select(F.least("nid", "p").alias("a"), F.greatest("nid", "p").alias("b")).distinct()

    wanted = scratch.cut(member.select("nid").distinct().join(classes.select("nid", "doc_id", "row_key"), "nid").withColumnsRenamed({"doc_id": "w_doc", "row_key": "w_row"}))
    few = (wanted.agg(F.sum(F.coalesce(F.octet_length(F.col("w_doc").cast("string")), F.lit(0)) + ID_BYTES)).first()[0] or 0) <= broadcast_bytes
    texts = keyed.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("row_key") == F.col("w_row")))
    sets = scratch.cut(texts.select("nid", "text").mapInArrow(_full_sets(words), "nid bigint, shingles array<bigint>").dropDuplicates(["nid"]))

    signature = classes.select("nid", "n_shingles", "sig", "parity")

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.withColumnsRenamed({"nid": name} | {c: f"{c}_{name}" for c in table.columns if c != "nid"})

    def confirm(pairs: DataFrame) -> DataFrame:
        full = pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "shingles_a", "shingles_b")
        return scratch.cut(full.mapInArrow(_confirmed(percent), "a bigint, b bigint"))

    likely = pairs.join(side(signature, "a"), "a").join(side(signature, "b"), "b").filter(possible(percent)).select("a", "b")
    links = confirm(likely)
    roots = components(links, scratch)

    # Buckets of two or three are done: all their pairs have been tested.
    rooted = member.filter("n > 3").select("bucket", "nid").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    counted = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    divided = counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n")).filter("parts > 1")
    divided = divided.select("bucket", F.col("most.root").alias("most"), ((F.col("n") - F.col("most.n")) * F.col("n") > compared).alias("large"))
    unsettled = scratch.cut(rooted.join(scratch.cut(divided), "bucket"))  # a table, as above
    if not unsettled.isEmpty():
        facts = unsettled.filter("not large").join(signature, "nid")
        x = facts.filter("root != most").select("bucket", "most", *[F.col(c).alias(f"{c}_a") for c in ("nid", "root", "n_shingles", "sig", "parity")])
        y = facts.select(F.col("bucket").alias("bucket_b"), *[F.col(c).alias(f"{c}_b") for c in ("nid", "root", "n_shingles", "sig", "parity")])
        untested = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("most")) | (F.col("nid_a") < F.col("nid_b")))
        more = x.join(y, (F.col("bucket") == F.col("bucket_b")) & untested & possible(percent)).select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b"))
        large = scratch.cut(unsettled.filter("large").select("nid", "root").distinct())
        if not large.isEmpty():
            met = _share_prefix(large, sets, percent, scratch)
            near = met.join(side(signature, "a"), "a").join(side(signature, "b"), "b").filter(possible(percent)).select("a", "b")
            more = more.unionByName(near)
        more = more.distinct()
        found = confirm(more)
        if not found.isEmpty():
            # Links between roots; the stars are known already.
            over = found.join(side(roots, "a"), "a", "left").join(side(roots, "b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
            above = components(over, scratch).select(F.col("nid").alias("root"), F.col("root").alias("top"))
            below = roots.join(above, "root", "left").select("nid", F.coalesce("top", "root").alias("root"))
            roots = scratch.cut(below.unionByName(above.select(F.col("root").alias("nid"), F.col("top").alias("root"))))

    of_class = classes.select("nid", "cls", "low").join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    lowest = of_class.groupBy("root").agg(F.min("low").alias("component_id"))
    labelled = of_class.join(lowest, "root").select("cls", "component_id")
    out = signed.select("doc_id", "row_key", "n_shingles", "cls").join(labelled, "cls", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's id, all columns unchanged."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select(F.col("doc_id").alias("__nd_id"), F.col("row_key").alias("__nd_row")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__nd_id")) & (F.xxhash64("text") == F.col("__nd_row")), "left_anti")
