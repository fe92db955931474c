import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import validate as V

CATALOG = [
    ("alarm", False, [("hour", "integer", True, None, 0, 23, None), ("days", "array", False, None, None, None, "string"), ("label", "string", False, None, None, None, None)]),
    ("call", True, [("phone_number", "string", True, None, None, None, None), ("kind", "string", False, ["voice", "video"], None, None, None), ("info", "object", False, None, None, None, None)]),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, V.CATALOG_SCHEMA)


CASES = [
    ({"tool": None, "status": "unsupported"}, []),
    ({"tool": None}, ["null tool requires clarification, unsupported or rejected status"]),
    ({}, ["null tool requires clarification, unsupported or rejected status"]),
    ({"tool": "fly"}, ["unknown tool: fly"]),
    ({"tool": "alarm", "arguments": [1]}, ["arguments must be an object"]),
    ({"tool": "alarm"}, ["arguments must be an object"]),
    ({"tool": "alarm", "arguments": {"hour": 6}, "requires_confirmation": False}, []),
    ({"tool": "alarm", "arguments": {"hour": 6}}, ["requires_confirmation must be false"]),
    ({"tool": "alarm", "arguments": {"hour": None}, "requires_confirmation": False}, ["missing required argument: hour"]),
    ({"tool": "alarm", "arguments": {"hour": True}, "requires_confirmation": False}, ["hour must be integer"]),
    ({"tool": "alarm", "arguments": {"hour": 6.0}, "requires_confirmation": False}, ["hour must be integer"]),
    ({"tool": "alarm", "arguments": {"hour": "6", "x": 1, "b": 2}, "requires_confirmation": True}, ["unknown arguments: b, x", "hour must be integer", "requires_confirmation must be false"]),
    ({"tool": "alarm", "arguments": {"hour": -1, "days": ["mon", 2]}, "requires_confirmation": False}, ["hour is below minimum", "days contains invalid item type"]),
    ({"tool": "alarm", "arguments": {"hour": 24}, "requires_confirmation": False}, ["hour is above maximum"]),
    ({"tool": "call", "arguments": {"phone_number": "", "kind": "smoke"}, "requires_confirmation": True}, ["kind is outside enum"]),
]


def test_calls(spark, catalog):
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(CASES)], "id int, j string").withColumn("prediction", F.parse_json("j"))
    got = {r.id: r.errors for r in V.validate_calls(rows, catalog).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_policy(spark, catalog):
    rows = spark.createDataFrame([(1, ["unknown tool: fly"], ["unknown"], None), (2, [], None, True), (3, ["x"], None, True), (4, [], ["x"], None)], "id int, errors array<string>, must_contain array<string>, must_be_valid boolean")
    assert {r.id: r.passed for r in V.policy_cases(rows).collect()} == {1: True, 2: True, 3: False, 4: False}


def item(i, **more):
    return {"id": f"v{i}", "utterance": "hello", "language": "vi", "intent": "open_app", "arguments": {"app_name": "x"}, "risk_level": "low", "split": "train"} | more


def test_items(spark):
    rows = [
        item(1), item(2, split="test"), item(1, utterance="other"), item(4, utterance="q", intent="nope"), item(5, utterance="w", arguments=[]), item(6, utterance="e", arguments={"app_name": ""}),
        item(7, utterance="r", intent="clarify", arguments={"missing": []}), {"id": "v8"}, item(9, utterance="t", intent="set_timer", arguments={"seconds": 0}), item(10, split="test"),
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows, 1)], "line_no int, j string").select("line_no", F.parse_json("j").alias("item"))
    got: dict = {}
    for r in V.validate_items(df).orderBy("line_no", "ord").collect():
        got.setdefault(r.line_no, []).append(r.message)
    assert got == {
        2: ["utterance leaks between splits train and test"], 3: ["duplicate id v1"], 4: ["unknown intent"], 5: ["arguments must be an object"], 6: ["open_app lacks app_name"], 7: ["clarify must name what is missing"],
        8: [f"lacks {f}" for f in ("utterance", "language", "intent", "arguments", "risk_level", "split")],
    }


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "intent string, utterance string")
    assert {(r.dimension, r.value): r.n for r in V.summarize_items(empty, ["intent"], "utterance").collect()} == {("all", "n"): 0.0, ("all", "unique_rate"): 0.0}


MATCHES = [
    ("hour", 6, 6, True), ("hour", 6, "6", False), ("hour", 1, True, True), ("hour", 6, 6.0, True), ("phone_number", "+84 91", "84-91", True), ("phone_number", "091", "+8491", False), ("name", "anh_minh", "Minh", True),
    ("title", "anh minh", "minh", False), ("label", "Gọi  Mẹ", "goi me", True), ("label", "none", None, True), ("days", ["b", "A"], ["a", "B"], True), ("days", ["a"], ["a", "a"], False),
    ("info", {"name": "chị Lan"}, {"name": "lan", "more": 1}, True), ("info", {"name": "x"}, [], False), ("flag", True, True, True), ("flag", True, "True", False),
]


def test_values_match(spark):
    rows = spark.createDataFrame([(i, n, json.dumps(e), json.dumps(a)) for i, (n, e, a, _) in enumerate(MATCHES)], "id int, name string, e string, a string")
    got = {r.id: r.m for r in rows.select("id", M.values_match(F.col("name"), F.parse_json("e"), F.parse_json("a")).alias("m")).collect()}
    assert got == {i: m for i, (*_, m) in enumerate(MATCHES)}


def test_report(spark, catalog):
    good = {"tool": "alarm", "arguments": {"hour": 6}, "requires_confirmation": False}
    gold = [("a", 1, "g", good), ("b", 2, None, {"tool": None, "status": "unsupported"}), ("c", 3, "g", good), ("d", 4, "g", good)]
    guess = [("a", 1, {"tool": "fly"}), ("a", 2, good), ("c", 3, good | {"arguments": {"hour": 6, "label": "x"}}), ("d", 4, good | {"arguments": {"hour": 7}})]
    e = spark.createDataFrame([(i, n, g, json.dumps(x)) for i, n, g, x in gold], "id string, line_no int, group string, j string").withColumn("expected", F.parse_json("j"))
    p = spark.createDataFrame([(i, n, json.dumps(x)) for i, n, x in guess], "id string, line_no int, j string").withColumn("prediction", F.parse_json("j"))
    scored = M.score_examples(e, p, catalog)
    rows = {r.id: r for r in scored.collect()}
    assert rows["a"].end_to_end  # the last row of an id wins
    assert rows["b"].tool_correct and not rows["b"].schema_valid and not rows["b"].status_correct  # missing prediction, null tool
    assert not rows["c"].arguments_exact and rows["c"].args_correct == rows["c"].args_total == 1
    assert not rows["d"].end_to_end
    total = M.report(scored).filter("group is null").first()
    assert (total["count"], total.tool_selection_accuracy, total.end_to_end_task_success, total.soft_argument_accuracy) == (4, 1.0, 0.25, pytest.approx(2 / 3))
    kinds = {r.id: r.k for r in scored.select("id", M.error_type().alias("k")).collect()}
    assert (kinds["c"], kinds["b"]) == ("argument_mismatch", "schema_invalid")
    variants = scored.select(*[F.count_if(c).alias(n) for n, c in M.end_to_end_variants().items()]).first().asDict()
    assert variants["canonical"] == 1 and variants["custom"] == 2 and variants["lenient_confirmed"] == 2 and variants["lenient_status"] == 2
    empty = M.report(M.score_examples(e.limit(0), p, catalog)).first()
    assert (empty["count"], empty.soft_argument_accuracy, empty.end_to_end_ci_95) == (0, 1.0, "N/A")


def test_protocol(spark, catalog):
    ok = json.dumps({"tool": "alarm", "arguments": {"hour": 6}, "requires_confirmation": False})
    rows = spark.createDataFrame([("1", "a", ok), ("1", "b", ok), ("2", "b", ok), ("3", "", json.dumps({"tool": "call"}))], "id string, query string, j string").withColumn("expected", F.parse_json("j"))
    got = sorted((r.id, r.message) for r in V.validate_protocol(rows, catalog, ["call"]).collect())
    assert got == [("1", "repeated id"), ("2", "repeated query"), ("3", "arguments must be an object"), ("3", "empty query"), ("3", "forbidden tool")]


def test_fields_and_schema(spark, catalog):
    """A12, A16, V21 and the other reports on a few calls."""
    good = {"tool": "alarm", "arguments": {"hour": 6}, "requires_confirmation": False}
    null = {"tool": None, "status": "unsupported", "arguments": {}}
    gold = [("a", good), ("b", good), ("c", null), ("d", null)]
    guess = [("a", good), ("b", good | {"arguments": {"hour": 7}}), ("c", null), ("d", good | {"status": "unsupported"}), ("z", good)]
    made = lambda rows, c: spark.createDataFrame([(i, n, "g", json.dumps(x)) for n, (i, x) in enumerate(rows)], "id string, line_no int, group string, j string").withColumn(c, F.parse_json("j"))
    e, p = made(gold, "expected"), made(guess, "prediction")
    scored = M.score_examples(e, p, catalog)
    assert [tuple(r) for r in M.field_accuracy(scored).select("field", "correct", "total").collect()] == [("hour", 1, 2)]
    r = M.negative_accuracy(scored).first()
    assert (r.n_null, r.null_status_accuracy, r.status_only_accuracy) == (2, 0.5, 1.0)
    r = M.success_of_predictions(e, p, catalog).first()
    assert (r["count"], r.tool_acc, r.e2e) == (5, 0.6, 0.6)
    tools = {r["name"]: r.required for r in V.decoding_schema(catalog).collect()}
    assert "hour" in tools["alarm"]


def test_candidate_and_schema_document(spark):
    item = {"id": "v1", "utterance": "mở bản đồ", "language": "vi", "intent": "open_map", "arguments": {"destination": "x"}, "risk_level": "low", "split": "train"}
    made = lambda rows: spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows, 1)], "line_no bigint, j string").withColumn("item", F.parse_json("j"))
    known = made([item, item | {"id": "v1"}])
    new = made([item | {"id": "v1", "split": "test"}])
    assert [r.message for r in V.validate_candidate(known, new).orderBy("ord").collect()] == ["duplicate id v1", "utterance leaks between splits train and test"]
    assert V.validate_candidate(known, made([item | {"id": "v9", "utterance": "khác"}])).count() == 0
    odd = made([item, item | {"utterance": "x", "language": "en", "risk_level": "none", "split": "dev", "intent": "fly"}])
    assert sorted((r.line_no, r.field) for r in V.schema_faults(odd).collect()) == [(2, f) for f in sorted(("utterance", "language", "risk_level", "split", "intent"))]


def test_catalogs_are_bounded(spark, catalog):
    with pytest.raises(ValueError, match="more than 1 rows"):
        V.small(catalog, 1)


def test_mcnemar_of_large_counts(spark):
    """Sums from the first term and from the largest agree with exact integers."""
    from math import comb

    from tessera.functions import stats

    pairs = [(0, 0), (1, 0), (43, 12), (16, 8), (5200, 5300), (10_001, 10_400), (30_000, 30_500), (200_000, 190_000)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b bigint, c bigint")
    got = {r.i: r.p for r in rows.select("i", stats.mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()}
    for i, (b, c) in enumerate(pairs[:6]):
        n, k = b + c, min(b, c)
        want = min(1.0, 2 * sum(comb(n, j) for j in range(max(0, k - 3000), k + 1)) / (1 << n)) if n else 1.0
        assert got[i] == pytest.approx(want, rel=1e-7)
    assert got[6] == pytest.approx(0.0424, abs=2e-3) and got[7] < 1e-50
