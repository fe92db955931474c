import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import baselines, build
from tessera.operators import metrics as M
from tessera.sources import io
from tessera.streaming import resume, windows


def test_stratified_split(spark):
    rows = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 33 else None) for i in range(40)], "id int, g string")
    out = build.stratified_split(rows, "g", "id", forced_train=F.col("id") < 5).collect()
    got = Counter((r.g, r.split) for r in out)
    assert got == {("a", "test"): 6, ("a", "train"): 24, ("b", "test"): 3, (None, "test"): 4, (None, "train"): 3}
    assert all(r.split == "train" for r in out if r.id < 5)
    again = build.stratified_split(rows.repartition(7), "g", "id", forced_train=F.col("id") < 5).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


@pytest.mark.parametrize("total", [3, 10, 17, 40])
def test_quotas_against_rounds(spark, total):
    sizes = {"a": 13, "b": 7, "c": 2, "d": 29}
    want = {k: max(1, int(n * 0.2)) for k, n in sizes.items()}
    while sum(want.values()) < total:
        k = max(sizes, key=lambda c: (round(sizes[c] * 0.2 - want[c], 9), sizes[c], c))
        want[k] += 1
    df = spark.createDataFrame(list(sizes.items()), "class string, n bigint")
    assert {r["class"]: r.quota for r in build.quotas(df, total).collect()} == want


def _draw(*keys):
    import hashlib

    return int(hashlib.md5(":".join(["42", *map(str, keys)]).encode()).hexdigest()[:13], 16) / (1 << 52)


def _typos(text, key, rate, substitute):
    out, i, kinds = list(text), 0, 3 if substitute else 2
    for i in range(len(out)):
        if _draw(key, i + 1, "typo") < rate:
            kind = int(_draw(key, i + 1, "how") * kinds)
            if kind == 0 and i + 1 < len(out):
                out[i], out[i + 1] = out[i + 1], out[i]
            elif kind == 1:
                out[i] = ""
            elif kind == 2 and out[i].lower() in build.NEIGHBOURS:
                out[i] = build.NEIGHBOURS[out[i].lower()][int(_draw(key, i + 1, "key") * 2)]
    return "".join(out)


def _fillers(text, key, rate):
    words = text.split()
    for turn in range(1, max(1, int(len(words) * rate * 0.5)) + 1):
        at = int(_draw(key, turn, "place") * (len(words) + 1))
        words.insert(at, build.FILLERS[int(_draw(key, turn, "which") * len(build.FILLERS))])
    return " ".join(words)


def _merged(text, key, rate):
    words = text.split()
    if len(words) < 2:
        return text
    closed = sorted(range(1, len(words)), key=lambda i: (_draw(key, i, "merge"), i))[: max(1, int(len(words) * rate))]
    return words[0] + "".join(("" if i in closed else " ") + words[i] for i in range(1, len(words)))


NOISY = ["Gọi cho mẹ ngay bây giờ nhé bạn", "một", "", "  hai   từ ", "a bc def ghij klmno pqrstu vwxyz " * 3]


@pytest.mark.parametrize("rate", [0.05, 0.4, 1.0])
def test_noise_steps(spark, rate):
    """Each step against a plain loop with the same draws."""
    rows = spark.createDataFrame(list(enumerate(NOISY)) + [(99, None)], "id int, t string")
    k, t = F.col("id"), F.col("t")
    got = {r.id: r for r in rows.select("id", build.typos(t, k, rate).alias("a"), build.typos(t, k, rate, substitute=True).alias("b"), build.insert_fillers(t, build.FILLERS, k, rate).alias("c"), build.merge_words(t, k, rate).alias("d")).collect()}
    for i, text in enumerate(NOISY):
        assert (got[i].a, got[i].b, got[i].c, got[i].d) == (_typos(text, i, rate, False), _typos(text, i, rate, True), _fillers(text, i, rate), _merged(text, i, rate))
    assert got[99].a is None and got[99].d is None


def test_noise_is_fixed_by_its_key(spark):
    rows = spark.createDataFrame([(str(i), "Gọi cho mẹ ngay bây giờ nhé bạn") for i in range(40)] + [("e", ""), ("n", None)], "id string, query string")
    a = {r.id: r.query for r in build.add_noise(rows, "query", "id").collect()}
    b = {r.id: r.query for r in build.add_noise(rows.repartition(5), "query", "id").collect()}
    assert a == b and len(a) == 42 * 3
    changed = {level: sum(a[f"{i}_{level}"] != "Gọi cho mẹ ngay bây giờ nhé bạn" for i in range(40)) for level in build.LEVELS}
    assert changed["light"] <= changed["heavy"] == 40 and changed["light"] > 10
    assert a["n_light"] is None and a["e_heavy"] is not None
    out = build.training_noise(rows, "query", "id").collect()
    assert len(out) == len({r.id for r in out}) == 42 * 3 and sum(r.noise_level is None for r in out) == 42


def test_ordinals(spark):
    rows = spark.range(0, 1000, numPartitions=7).selectExpr("(id * 37) % 1000 as v", "id as __n")
    assert {r.v: r.ordinal for r in build.ordinals(rows, ["v"]).collect()} == {v: v + 1 for v in range(1000)}
    assert build.ordinals(rows.limit(0), ["v"]).count() == 0
    assert [tuple(r) for r in build.zipped(rows.filter("v < 3").select("v"), spark.range(5, 100), ["v"], ["id"]).orderBy("v").collect()] == [(0, 5), (1, 6), (2, 7)]


def test_marks(spark):
    toneless, bare = build.strip_tones_then_shapes(F.lit("Đặt lại ở đâu"))
    assert spark.range(1).select(toneless, bare).first()[:] == ("Đăt lai ơ đâu", "Dat lai o dau")


def test_rules(spark):
    rows = spark.createDataFrame([("Đặt báo thức 6 giờ 30",), ("gọi 0912345678",), ("gọi 0912 345 678",), ("xin chào",), (None,)], "q string")
    got = [(r.tool, r.status, r.requires_confirmation, dict(r.arguments)) for r in baselines.predict_by_rules(rows, "q").collect()]
    assert got == [
        ("ACTION_SET_ALARM", None, False, {"EXTRA_HOUR": "6", "EXTRA_MINUTES": "30"}), ("dial", None, True, {"phone_number": '"0912345678"'}), (None, "clarification", False, {}),
        (None, "unsupported", False, {}), (None, "unsupported", False, {}),
    ]
    said = baselines.rule_predictor("q")(rows.limit(2)).select(F.to_json("prediction").alias("p")).collect()
    assert [json.loads(r.p) for r in said] == [{"tool": "ACTION_SET_ALARM", "arguments": {"EXTRA_HOUR": 6, "EXTRA_MINUTES": 30}, "requires_confirmation": False}, {"tool": "dial", "arguments": {"phone_number": "0912345678"}, "requires_confirmation": True}]
    given = baselines.batch_predictor(lambda texts: [json.dumps({"tool": t[:3]}) for t in texts], "q")(rows).select(F.to_json("prediction").alias("p"), "latency_ms").collect()
    assert [json.loads(r.p)["tool"] for r in given] == ["Đặt", "gọi", "gọi", "xin", ""] and all(r.latency_ms >= 0 for r in given)


def test_readers(spark, tmp_path):
    """One JSON value, the first text, files by glob and by name; line numbers over several splits."""
    from tessera.functions import text as X

    (tmp_path / "a").mkdir()
    lines = [json.dumps({"id": i}) for i in range(3000)]
    (tmp_path / "b.jsonl").write_text("\ufeff" + "\r\n".join([*lines[:10], "", *lines[10:]]) + "\n", encoding="utf-8")
    (tmp_path / "c.jsonl").write_text('{"id": -1}\n{"id"', encoding="utf-8")
    (tmp_path / "a" / "b.jsonl").write_text('{"id": -2}', encoding="utf-8")
    (tmp_path / "d.json").write_text('{"n": 1,\n "m": [1, 2]}', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows = io.read_jsonl(spark, str(tmp_path / "b.jsonl"))
        assert rows.select("line_no").rdd.getNumPartitions() > 3
        got = {r.line_no: r.id for r in rows.select("line_no", F.try_variant_get("row", "$.id", "int").alias("id")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i + 1 + (i >= 10): i for i in range(3000)}
    names = io.read_glob(spark, f"{tmp_path}/*.jsonl", without=["c.jsonl"])
    assert [n.rsplit("/", 1)[-1] for n in names] == ["b.jsonl"]
    assert io.read_union(spark, f"{tmp_path}/*.jsonl", ["c.jsonl"]).count() == 3000
    assert [n.split(str(tmp_path))[1] for n in io.locate(spark, str(tmp_path), "b.jsonl")] == ["/b.jsonl", "/a/b.jsonl"]
    doc = io.read_json_document(spark, str(tmp_path / "d.json"), "n int, m array<int>").first()
    assert (doc.n, doc.m) == (1, [1, 2])
    pairs = spark.createDataFrame([(None, "b"), ("", "c"), ("a", "d"), (None, None)], "x string, y string")
    assert [r.t for r in pairs.select(X.first_text(F.col("x"), F.col("y")).alias("t")).collect()] == ["b", "c", "a", ""]
    numbers = spark.createDataFrame([(2.675,), (0.5,), (1.5,), (None,)], "v double")
    assert [r.t for r in numbers.select(X.half_even(F.col("v"), 2).alias("t")).collect()] == [2.67, 0.5, 1.5, None]
    assert [r.t for r in numbers.select(X.half_even(F.col("v"), 0).alias("t")).collect()] == [3.0, 0.0, 2.0, None]
    assert pairs.select(X.pick("x", z="y").alias("s")).schema["s"].dataType.names == ["x", "z"]


def test_tfidf_baseline(spark):
    label = F.when(F.col("id") % 2 == 0, "alarm clock").otherwise("phone call")
    rows = spark.range(24).select(F.concat_ws(" ", label, label, F.lit("so"), F.col("id").cast("string")).alias("q"), label.alias("label"))
    rows = rows.withColumn("chars", baselines.edge_ngrams(F.col("q"))).withColumn("words", baselines.word_ngrams(F.col("q")))
    models = [baselines.tfidf_model(rows, c, "label", iterations=30) for c in ("chars", "words")]
    scored = [m(rows).withColumnRenamed("label_scores", f"s{i}") for i, m in enumerate(models)]
    both = scored[0].join(scored[1].select("q", "s1"), "q").select("label", baselines.soft_vote(F.col("s0"), F.col("s1")).alias("guess"))
    assert both.filter("label = guess").count() == 24
    assert spark.range(1).select(baselines.edge_ngrams(F.lit("ab"), 2, 4)).first()[0] == [" a", "ab", "b ", " ab", "ab ", " ab "]


def test_sets_and_coverage(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string"), spark.createDataFrame([(2,), (3,)], "id int")
    assert {(r.id, r.t) for r in build.union_all([a, b]).collect()} == {(1, "x"), (2, "y"), (2, None), (3, None)}
    assert {(r.key, r.side) for r in M.missing_and_extra(a, b, "id").collect()} == {(1, "missing"), (3, "extra")}
    assert {(r.key, r.side) for r in M.coverage(a, "id", b, "id").collect()} == {(1, "unexpected"), (3, "missing")}
    assert [r.id for r in build.blocked(a, "id", [b]).collect()] == [1]


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return f"file://{path}"


def test_jsonl_modes(spark, tmp_path):
    good = write(tmp_path / "good.jsonl", '﻿{"id":"a"}\n\n{"id":"b"}')
    got = [(r.line_no, r.id) for r in io.read_jsonl(spark, good).select("line_no", F.try_variant_get("row", "$.id", "string").alias("id")).collect()]
    assert got == [(1, "a"), (3, "b")]
    cut = write(tmp_path / "cut.jsonl", '{"id":"a"}\n{"id":"b"}\n{"id":')
    broken = write(tmp_path / "broken.jsonl", '{"id":"a"}\n{"id":\n{"id":"c"}\n')
    assert io.read_jsonl(spark, cut, "resume").count() == 2
    assert io.read_jsonl(spark, broken, "permissive").filter("row is null").count() == 1
    for mode in ("failfast", "resume"):
        with pytest.raises(Exception, match="bad JSON"):
            io.read_jsonl(spark, broken, mode).collect()
    marked = io.read_jsonl(spark, [good, broken], "marker").select(F.try_variant_get("row", "$.id", "string").alias("id"))
    assert sorted(r.id for r in marked.collect()) == ["__LOAD_ERROR__", "a", "b"]
    new, counts = io.import_rows(spark.createDataFrame([("a",)], "id string"), io.read_jsonl(spark, [good, broken], "permissive"))
    assert new.count() == 2 and tuple(counts.first()) == (5, 1)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"], True), ("b|", [], False)], "id string, flags array<string>, ok boolean")
    ledger = io.ledger_columns(rows, lists=["flags"])
    io.write_csv(ledger, f"file://{tmp_path}/csv")
    assert sorted(map(tuple, io.read_csv(spark, f"file://{tmp_path}/csv", "id string, flags string, ok string").fillna("").collect())) == [("a", "x|y", "True"), ("b|", "", "False")]
    io.write_jsonl(rows, f"file://{tmp_path}/j", single=True)
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2
    assert "| b\\| |" in io.markdown(rows.select("id"), "T")
    assert "No rows" in io.markdown(rows.limit(0), "T")
    io.write_report(rows.select("id"), f"file://{tmp_path}/r")
    assert json.loads("\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/r").collect()))[0]["id"] == "a"
    f = write(tmp_path / "h.txt", "abc")
    io.require_hash(spark, f, "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD")
    with pytest.raises(ValueError):
        io.require_hash(spark, f, "00")
    io.replace_with_backup(rows, f"file://{tmp_path}/p", f"file://{tmp_path}/p0")
    io.replace_with_backup(rows.limit(1), f"file://{tmp_path}/p", f"file://{tmp_path}/p1")
    assert (spark.read.parquet(f"file://{tmp_path}/p").count(), spark.read.parquet(f"file://{tmp_path}/p1").count()) == (1, 2)


def test_logs(spark):
    lines = spark.createDataFrame([("x BENCH_RESULT run=3 ttft_ms=4918 tps=4.8 tool=null ok=true",), ("BENCH_RAM run=3 used_mb=578",), ("noise",)], "line string")
    assert tuple(io.parse_results(lines).first()) == (3, 4918, 4.8, None, True)
    assert tuple(io.parse_memory(lines).first()) == (3, 578)


def test_resume(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id":"a"}\n{"id":"b"}\n{"id":"a"}\n')
    predict = lambda d: d.withColumn("prediction", F.upper("id"))
    run = lambda: resume.append_predictions(spark, f"file://{src}", "id string", predict, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    read = lambda: sorted(r.prediction for r in resume.read_appended(spark, f"file://{tmp_path}/out", "id string, prediction string").collect())
    run()
    assert read() == ["A", "B"]
    (src / "2.json").write_text('{"id":"b"}\n{"id":"c"}\n')
    run()
    assert read() == ["A", "B", "C"]
    examples = spark.createDataFrame([("a",), ("d",)], "id string")
    done = spark.createDataFrame([("a", "p"), ("a", "q"), ("z", "p")], "id string, protocol_id string")
    assert [r.id for r in resume.pending(examples, done).collect()] == ["d"]
    assert sorted(map(tuple, resume.resume_faults(examples, done).collect())) == [("mixed protocol", "q"), ("repeated", "a"), ("unknown", "z")]


def test_windows(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:20:00", 2.0), ("a", "2024-01-01 02:00:00", 4.0)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted((r.n, r.total) for r in windows.tumbling(rows, "t", "1 hour", ["k"], "v").collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in windows.sessions(rows, "t", "30 minutes", ["k"]).collect()) == [1, 2]


def test_reports_are_whole_or_an_error(spark, tmp_path):
    import pytest

    from tessera.sources import io

    with pytest.raises(ValueError, match="10000 rows"):
        io.write_report(spark.range(10_001), f"file://{tmp_path}/long")
    with pytest.raises(ValueError, match="1000 rows"):
        io.markdown(spark.range(1_001), "t")
    assert io.markdown(spark.range(1_000), "t").count("\n") >= 1_000


def test_gaps_are_drawn_once_a_text(spark):
    """merging is in proportion to a text's gaps, not to their square."""
    import time

    from tessera.operators import build

    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(3000))) for i in range(4)], "id bigint, text string")
    started = time.time()
    got = rows.select(build.merge_words(F.col("text"), F.col("id"), 0.1).alias("t")).collect()
    assert all(len(r.t.split(" ")) == 2700 and r.t.replace(" ", "") == "".join(f"w{j}" for j in range(3000)) for r in got)
    assert time.time() - started < 20
