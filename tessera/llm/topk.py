"""Exact top-k search by columnar branch-and-bound.

Vectors are turned into integers, floor(scale * x), and stored vertically: one
row of an array per dimension.  For a block of queries and a block of
candidates the inner products of the first dimensions are accumulated for all
pairs; then, query by query, candidates whose partial score plus the most the
remaining dimensions can give (the product of the remaining norms) is below the
query's bound are dropped, the survivors are compacted, and the next block of
dimensions is accumulated for them alone.  The bound is the k-th best exact
score the task has seen for the query, and from the start the k-th best of a
seed sample, so nothing that belongs to the result is ever dropped.

Queries lie in tiles of at most about ``query_block`` rows, made by the
executors (``operators.tiles``); no query passes through the driver's Python, and every
task returns at most k rows a query.

Cases.  Vectors that are null or empty, or hold null or non-finite components, take no
part.  Vectors of another length than the query's take no part for it.  Ties go
to the smaller id.  A query sees every row but those with its own id.  Rows of
a repeated id are queries and candidates of their own, each query with ranks
from 1; equal rows of candidates take a rank each.  Scores are exact while they and their
parts stay below 2**63.  An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._store import Scratch, bound_batches
from tessera.operators import tiles as _tiles

DIMS_AT_ONCE = 16
CANDIDATES_AT_ONCE = 8192
SEED_ROWS = 2048


def whole(vector: Column) -> Column:
    """Not null or empty, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column, np):
    """(rows, dims) of int64 for each length that occurs: {dims: (row numbers, matrix)}."""
    offsets = column.offsets.to_numpy()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64)
    base, sizes = offsets[0], np.diff(offsets)
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = rows, flat[(offsets[rows] - base)[:, None] + np.arange(d)]
    return out


class Search:
    """A block of queries of one length against candidate blocks."""

    def __init__(self, ids, vectors, k: int, floor):
        import numpy as np

        self.np, self.k = np, k
        self.ids, self.v = ids, vectors
        self.floor = floor.copy()  # the least score that can still matter, for each query
        n, self.d = vectors.shape
        self.best_score = np.full((n, k), np.iinfo(np.int64).min)
        self.best_id = np.full((n, k), np.iinfo(np.int64).max)
        self.has = np.zeros((n, k), bool)
        self.rest = self._rest(vectors.T)  # (blocks + 1, n)
        self.most = int(np.abs(vectors).max(initial=0))

    def _rest(self, columns):
        """Norm of the dimensions from each block's start on."""
        np = self.np
        squares = (columns.astype(np.float64) ** 2).reshape(self.d, -1)
        tail = np.concatenate([squares[::-1].cumsum(0)[::-1], np.zeros((1, squares.shape[1]))])
        cuts = [*range(0, self.d, DIMS_AT_ONCE), self.d]
        return np.sqrt(tail[cuts])

    def offer(self, ids, vectors) -> None:
        np = self.np
        columns = np.ascontiguousarray(vectors.T)  # vertical layout
        # float64 is exact below 2**53; a sum of d products can't pass d * most * most.
        exact = self.d * self.most * int(np.abs(vectors).max(initial=0)) < 1 << 53
        kind = np.float64 if exact else np.int64
        columns, queries = columns.astype(kind), self.v.astype(kind)
        rest = self._rest(columns)
        cuts = [*range(0, self.d, DIMS_AT_ONCE), self.d]
        head = min(2, len(cuts) - 1)  # blocks that all candidates are given
        partial = queries[:, : cuts[head]] @ columns[: cuts[head]]
        slack = 1e-6 if exact else 1.0
        for q in range(len(self.ids)):
            alive, score = None, partial[q]
            for b in range(head, len(cuts)):
                bound = score + self.rest[b][q] * (rest[b] if alive is None else rest[b][alive]) * (1 + 1e-9) + slack
                keep = np.flatnonzero(bound >= self.floor[q])
                alive = keep if alive is None else alive[keep]
                score = score[keep]
                if b + 1 >= len(cuts) or not len(alive):
                    break
                part = columns[cuts[b] : cuts[b + 1], alive] if len(alive) * 4 < columns.shape[1] else columns[cuts[b] : cuts[b + 1]][:, alive]
                score = score + queries[q, cuts[b] : cuts[b + 1]] @ part
            if len(alive):
                self._take(q, ids[alive], score.astype(np.int64))

    def _take(self, q: int, ids, score) -> None:
        np = self.np
        other = (ids != self.ids[q]) & (score >= self.floor[q])
        if not other.all():
            ids, score = ids[other], score[other]
        if not len(ids):
            return
        old = self.has[q]
        ids, score = np.concatenate([self.best_id[q][old], ids]), np.concatenate([self.best_score[q][old], score])
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            near = score >= least
            ids, score = ids[near], score[near]
        order = np.lexsort((ids, -score))[: self.k]
        m = len(order)
        self.best_id[q, :m], self.best_score[q, :m], self.has[q, :m] = ids[order], score[order], True
        if m == self.k:
            self.floor[q] = max(self.floor[q], self.best_score[q, m - 1])


class _Tile:
    """A tile's queries, by the length of their vectors, against packs of candidates."""

    def __init__(self, queries: pa.Table, k: int):
        import numpy as np

        self.np = np
        ids, rows, floors = (queries.column(c).to_numpy() for c in ("vec_id", "row", "floor"))
        self.search = {d: (rows[at], Search(ids[at], m, k, floors[at])) for d, (at, m) in _matrix(_list(queries.column("v")), np).items()}

    def offer(self, pack: pa.Table) -> None:
        ids = pack.column("vec_id").to_numpy()
        for d, (rows, matrix) in _matrix(_list(pack.column("v")), self.np).items():
            for a in range(0, len(rows), CANDIDATES_AT_ONCE) if d in self.search else ():
                self.search[d][1].offer(ids[rows[a : a + CANDIDATES_AT_ONCE]], matrix[a : a + CANDIDATES_AT_ONCE])

    def found(self) -> pa.RecordBatch:
        parts = [(rows, s, s.has.sum(1)) for rows, s in self.search.values()]
        both = lambda arrays: pa.array(self.np.concatenate([self.np.zeros(0, self.np.int64), *arrays]))
        columns = [both(self.np.repeat(s.ids, n) for _, s, n in parts), both(self.np.repeat(rows, n) for rows, _, n in parts), both(s.best_id[s.has] for _, s, _ in parts), both(s.best_score[s.has] for _, s, _ in parts)]
        return pa.RecordBatch.from_arrays(columns, names=["query_id", "row", "vec_id", "score"])


class _Seeded(_Tile):
    """The tile with its queries' floors after a sample of candidates."""

    def __init__(self, number: int, queries: pa.Table, k: int):
        super().__init__(queries, k)
        self.number, self.queries = number, queries

    def found(self) -> pa.RecordBatch:
        floor = dict(zip(self.np.concatenate([r for r, _ in self.search.values()]).tolist(), self.np.concatenate([s.floor for _, s in self.search.values()]).tolist()))
        floors = pa.array([floor[r] for r in self.queries.column("row").to_pylist()], pa.int64())
        data = _tiles.packed_bytes(self.queries.drop_columns("floor").append_column("floor", floors))
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int32()), pa.array([data], pa.binary())], names=["tile", "data"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, broadcast_bytes: int = _tiles.BROADCAST_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products."""
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "topk")
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = vectors.filter(F.col(id_col).isNotNull() & whole(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"), is_query.alias("q"))
    candidates = rows.select("vec_id", "v")
    # Rows are numbered in a table, so that they are the same in every attempt of a task.
    queries = scratch.cut(rows.filter("q").select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()).withColumn("floor", F.lit(-(1 << 63))))
    tiles = max(1, -(-queries.count() // query_block))
    asked = _tiles.shown(_tiles.tiled(queries, tiles, scratch.cut), candidates.limit(SEED_ROWS), lambda n, t: _Seeded(n, t, k), "tile int, data binary")
    found = _tiles.met(scratch.cut(asked), tiles, candidates, lambda _, t: _Tile(t, k), "query_id bigint, row bigint, vec_id bigint, score bigint", broadcast_bytes)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _list(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
