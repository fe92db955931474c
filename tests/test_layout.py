"""Tiles against all rows, and tables that are kept."""

import pyarrow as pa
import pytest

from tessera.operators import layout, tiles


class _Pairs:
    """For each query the number of candidates and their sum."""

    def __init__(self, number, queries):
        self.number, self.ids = number, queries.column("id").to_pylist()
        self.n = self.total = 0

    def offer(self, pack):
        self.n += pack.num_rows
        self.total += sum(pack.column("x").to_pylist())

    def found(self):
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), *(pa.array([v] * len(self.ids), pa.int64()) for v in (self.n, self.total))], names=["id", "n", "total"])


@pytest.mark.parametrize(("broadcast_bytes", "group_bytes"), [(1 << 20, 1 << 20), (0, 1 << 20), (0, 900), (0, 1)])
def test_every_pack_meets_every_tile(spark, broadcast_bytes, group_bytes):
    tiled = tiles.tiled(spark.range(40), 5)
    candidates = spark.range(1000, numPartitions=6).selectExpr("id x")
    rows = tiles.met(tiled, 5, candidates, _Pairs, "id bigint, n bigint, total bigint", broadcast_bytes, group_bytes).groupBy("id").sum("n", "total").collect()
    assert sorted(map(tuple, rows)) == [(i, 1000, 499500) for i in range(40)]
    empty = tiles.met(tiles.tiled(spark.range(0), 1), 1, candidates, _Pairs, "id bigint, n bigint, total bigint", broadcast_bytes, group_bytes)
    assert empty.count() == 0


def test_packs_travel_once_a_group(spark):
    tiled = tiles.tiled(spark.range(60), 6)
    candidates = spark.range(1000, numPartitions=3).selectExpr("id x")
    packs = candidates.mapInArrow(tiles._packed, "data binary").count()
    for groups in (1, 2, 6):
        assert tiles.dealt(tiled, 6, candidates, groups).filter("tile is null").count() == packs * groups
    plan = tiles.dealt(tiled, 6, candidates, 2)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_kept_tables(spark):
    rows = spark.range(5).selectExpr("id", "array(struct(id as x, string(id) as y)) a", "parse_json(string(id)) v", "cast(null as double) d")
    table = layout.kept(rows)
    assert table.schema.simpleString() == rows.schema.simpleString() and "Scan parquet" in table._jdf.queryExecution().toString()
    assert sorted(r.id for r in table.collect()) == list(range(5))
    assert layout.shared_dir(spark) in table.inputFiles()[0]
