"""A stated set of queries against all rows, in tiles.

Queries are dealt out to tiles of about one size by the executors; a tile is
one row that holds its queries as an Arrow stream.  Candidates are gathered to
packs of about ``PACK_BYTES`` without a shuffle.  Every pack meets every tile.

Tiles of at most ``broadcast_bytes`` together, as measured, are broadcast, and
candidates go to Python once.  Beyond, tiles form groups of about
``GROUP_BYTES``: a pack is sent once for each group, not for each tile, to a
task that holds the group's tiles and reads the packs one after the other.  So
candidates travel (bytes of all tiles / ``GROUP_BYTES``) times, and a task holds
a group and one pack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.layout import kept

BROADCAST_BYTES = 16 << 20
PACK_BYTES = 4 << 20
GROUP_BYTES = 64 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mine: list[pa.RecordBatch] = []
    for batch in batches:
        mine.append(batch)
        if sum(b.nbytes for b in mine) >= PACK_BYTES:
            yield _row(mine)
            mine = []
    yield _row(mine)


def _packed_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _row(list(batches))


def _row(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    some = [b for b in batches if b.num_rows]
    return pa.RecordBatch.from_arrays([pa.array([packed_bytes(pa.Table.from_batches(some).combine_chunks())] if some else [], pa.binary())], names=["data"])


def packed_bytes(table: pa.Table) -> bytes:
    """What ``unpacked`` turns into the table again."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def tiled(queries: DataFrame, count: int, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """(tile, data): the queries dealt out to ``count`` tiles, written by ``keep``."""
    return keep(queries.repartition(count).mapInArrow(_packed_whole, "data binary").withColumn("tile", F.spark_partition_id()).select("tile", "data"))


def _told(held: dict[int, object], pack: pa.Table) -> Iterator[pa.RecordBatch]:
    for one in held.values():
        if (some := one.offer(pack)) is not None:
            yield some


def _beside(work: Callable, tiles):
    """Batches of candidates against tiles that every task has; at the end what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {number: work(number, unpacked(pa.scalar(data))) for number, data in tiles.value}
        mine: list[pa.RecordBatch] = []
        for batch in batches:
            mine += [batch] if batch.num_rows else []
            if sum(b.nbytes for b in mine) >= PACK_BYTES:
                yield from _told(held, pa.Table.from_batches(mine))
                mine = []
        if mine:
            yield from _told(held, pa.Table.from_batches(mine))
        yield from (done.found() for done in held.values())

    return run


def _grouped(work: Callable):
    """(place, tile, data), in order of place: a group's tiles (tile is not null), then its packs; at the end of a group what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}
        now, told = None, False
        for batch in batches:
            for place, tile, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                if place.as_py() != now:
                    yield from (done.found() for done in held.values() if told)
                    held, now, told = {}, place.as_py(), False
                if tile.is_valid:
                    held[tile.as_py()] = work(tile.as_py(), unpacked(data))
                else:
                    told = True
                    yield from _told(held, unpacked(data))
        yield from (done.found() for done in held.values() if told)

    return run


def dealt(tiles: DataFrame, count: int, candidates: DataFrame, groups: int) -> DataFrame:
    """(place, tile, data): each group of tiles, and each pack of candidates once for each group, dealt out to places and in order."""
    slices = max(1, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda part: (F.col("group") * F.lit(slices) + part).cast("int").alias("place")
    stated = tiles.select(F.pmod("tile", F.lit(groups)).alias("group"), "tile", "data", upto(slices).alias("slice")).select(place(F.col("slice")), "tile", "data")
    packs = candidates.mapInArrow(_packed, "data binary").select(F.pmod(F.monotonically_increasing_id(), F.lit(slices)).alias("slice"), "data")
    packs = packs.select("slice", "data", upto(groups).alias("group")).select(place(F.col("slice")), F.lit(None).cast("int").alias("tile"), "data")
    return stated.unionByName(packs).repartition("place").sortWithinPartitions("place", F.col("tile").asc_nulls_last())


def met(tiles: DataFrame, count: int, candidates: DataFrame, work: Callable, schema: str, broadcast_bytes: int = BROADCAST_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``work(number, queries)`` makes an object for a tile; its ``offer(table)`` gets packs of candidates, its ``found()`` gives a RecordBatch of ``schema``; ``offer`` may give one, too."""
    size = tiles.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size <= broadcast_bytes:
        stated = [(r.tile, bytes(r.data)) for r in tiles.filter("data is not null").collect()]
        return candidates.mapInArrow(_beside(work, tiles.sparkSession.sparkContext.broadcast(stated)), schema)
    groups = min(count, -(-size // max(1, group_bytes)))
    return dealt(tiles.filter("data is not null"), count, candidates, groups).mapInArrow(_grouped(work), schema)


def shown(tiles: DataFrame, pack: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Every tile against one and the same pack; the rows of ``pack`` must be few."""
    one = pack.coalesce(1).mapInArrow(_packed_whole, "data binary").withColumnRenamed("data", "pack")
    both = tiles.join(F.broadcast(one)).select("tile", "data", "pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, mine, theirs in zip(*(batch.column(i) for i in range(3)), strict=True):
                held = {tile.as_py(): work(tile.as_py(), unpacked(mine))}
                yield from _told(held, unpacked(theirs))
                yield held[tile.as_py()].found()

    return both.mapInArrow(run, schema)
