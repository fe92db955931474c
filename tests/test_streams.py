"""Streams: versions that are whole, and state that is bounded."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import resume
from tessera.streaming.state import PROVIDER, repeated_lines
from tessera.streaming.versions import VersionedTable


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id string, x bigint")
    assert table.read().count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x bigint")
    assert table.commit(rows, "v1", "p") and not table.commit(rows, "v1", "p")
    assert table.read().count() == 2
    with pytest.raises(ValueError, match="protocol"):
        table.commit(rows, "v2", "q")
    failing = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("x"))
    with pytest.raises(Exception, match="lost"):
        table.commit(failing, "v2", "p")
    assert table.read().count() == 2 and set(table.entries()) == {"v1"}
    assert table.commit(failing.filter("id != '39'"), "v2", "p")
    assert table.read().count() == 41
    assert len(list((tmp_path / "t/data").iterdir())) == 2  # nothing is left of the failed one


def test_predictions_are_made_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out = f"file://{tmp_path}/out"

    def write(name, ids):
        (source / name).write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))

    def run(predict):
        return resume.append_predictions(spark, f"file://{source}", "id string", predict, out, f"file://{tmp_path}/cp")

    good = lambda rows: rows.withColumn("prediction", F.upper("id"))
    write("1.json", ["a", "b", "b"])
    run(good)
    write("2.json", ["b", "c"])
    with pytest.raises(Exception, match="no luck"):
        run(lambda rows: rows.withColumn("prediction", F.when(F.col("id") == "c", F.raise_error(F.lit("no luck"))).otherwise(F.col("id"))))
    read = lambda: sorted(map(tuple, resume.read_appended(spark, out, "id string, prediction string").collect()))
    assert read() == [("a", "A"), ("b", "B")]
    run(good)
    run(good)
    assert read() == [("a", "A"), ("b", "B"), ("c", "C")]


def test_state_over_a_stream(spark, tmp_path):
    """Shuffled lines in batches give the batch query's rows; keys that are long past leave the state."""
    rng = random.Random(2)
    lines = [(f"k{rng.randrange(40)}", i, f"2024-01-01 00:00:{i % 60:02d}") for i in range(200)]
    rng.shuffle(lines)
    source = tmp_path / "in"
    source.mkdir()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        rows = spark.readStream.schema("id string, line bigint, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{source}")
        found = repeated_lines(rows, "id", "line", "ts", late="10 minutes", keep_ms=3_600_000)

        def run():
            query = found.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"file://{tmp_path}/out")
            query.awaitTermination()
            return query

        for b in range(4):
            (source / f"{b}.json").write_text("".join(json.dumps({"id": i, "line": n, "ts": t}) + "\n" for i, n, t in lines[b::4]) + json.dumps({"id": None, "line": 1, "ts": lines[0][2]}) + "\n")
        run()
        first = {}
        for i, n, _ in lines:
            first[i] = min(n, first.get(i, n))
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted((i, n) for i, n, _ in lines if n != first[i])
        for b, day in ((5, 3), (6, 4)):
            (source / f"{b}.json").write_text(json.dumps({"id": f"new{b}", "line": 1000 + b, "ts": f"2024-01-0{day} 00:00:00"}) + "\n")
        query = run()
        rows_held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, query.recentProgress) if p["stateOperators"]]
        assert rows_held[-1] <= 6, rows_held  # two keys and their timers
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
