"""Whole runs on small files."""

import json

import pytest

from tessera import jobs

TOOLS = [
    {"name": "open_settings", "description_vi": "mở cài đặt", "description_en": "open settings", "confirmation": False, "arguments": {"setting_type": {"type": "string", "required": True}}},
    {"name": "dial", "description_vi": "gọi điện", "description_en": "call a number", "confirmation": True, "arguments": {"phone_number": {"type": "string", "required": True}}},
    {"name": "get_contact_info", "description_vi": "tìm liên hệ", "description_en": "look up", "confirmation": False, "arguments": {"name": {"type": "string", "required": True}, "key": {"type": "string", "required": True, "enum": ["phone", "email"]}}},
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    (base / "tools.json").write_text(json.dumps(TOOLS, ensure_ascii=False, indent=1), encoding="utf-8")
    call = lambda tool, args, confirm=False, **more: {"tool": tool, "arguments": args, "requires_confirmation": confirm} | more
    gold = [
        ("a", "settings", "Mở cài đặt wifi", call("open_settings", {"setting_type": "wifi"})), ("b", "call", "Gọi 0912345678", call("dial", {"phone_number": "0912345678"}, True)),
        ("c", None, "Hôm nay thế nào", call(None, {}, status="unsupported")), ("d", "call", "Tìm số điện thoại của Nam", call("get_contact_info", {"name": "Nam", "key": "email"})),
    ]
    (base / "gold.jsonl").write_text("\n".join(json.dumps({"id": i, "group": g, "query": q, "expected": e}, ensure_ascii=False) for i, g, q, e in gold), encoding="utf-8")
    return base


def test_route_and_evaluate(spark, files):
    out = str(files / "said")
    run = lambda **more: jobs.route(spark, str(files / "gold.jsonl"), str(files / "tools.json"), out, top_k=2, protocol_id="p1", **more)
    assert [r.id for r in run(task_ids=["b"]).collect()] == ["b"]
    assert sorted(r.id for r in run(resume=True).collect()) == list("acd")
    rows = [json.loads(x) for f in sorted((files / "said").glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert sorted(r["id"] for r in rows) == list("abcd") and all(len(r["retrieved_tools"]) == 2 and r["protocol_id"] == "p1" for r in rows)
    assert next(r["prediction"] for r in rows if r["id"] == "b") == {"tool": "dial", "arguments": {"phone_number": "0912345678"}, "requires_confirmation": True}
    run(resume=True)  # nothing is left
    assert sum(len(f.read_text().splitlines()) for f in (files / "said").glob("part-*")) == 4
    with pytest.raises(ValueError, match="can't resume"):
        jobs.route(spark, str(files / "gold.jsonl"), str(files / "tools.json"), out, resume=True, protocol_id="p2")
    report = jobs.evaluate(spark, out, str(files / "gold.jsonl"), str(files / "tools.json"), str(files / "report")).collect()
    total = next(r for r in report if r.group is None)
    assert (total["count"], total.tool_selection_accuracy, total.end_to_end_task_success) == (4, 1.0, 0.75)
    text = "".join(f.read_text(encoding="utf-8") for f in (files / "report" / "report").glob("part-*"))
    assert json.loads(text)[0]["count"] == 4
    tables = "".join(f.read_text(encoding="utf-8") for f in (files / "report" / "tables").glob("part-*"))
    assert "## Arguments" in tables and "| key | 0 | 1 | 0.0 |" in tables
    errors = "".join(f.read_text(encoding="utf-8") for f in (files / "report" / "errors").glob("part-*"))
    assert "argument_mismatch" in errors and errors.count("get_contact_info") >= 2


def test_incomplete_predictions(spark, files):
    (files / "few.jsonl").write_text('{"id": "a", "tool": "dial"}\n{"id": "z", "prediction": {}}\n', encoding="utf-8")
    ask = lambda out, **more: jobs.evaluate(spark, str(files / "few.jsonl"), str(files / "gold.jsonl"), str(files / "tools.json"), str(files / out), **more)
    with pytest.raises(ValueError, match="incomplete"):
        ask("r1")
    assert next(r for r in ask("r2", allow_partial=True).collect() if r.group is None)["count"] == 4


def test_post_processing(spark, files):
    from pyspark.sql import functions as F

    said = [
        {"tool": "open_settings", "arguments": {"setting_type": "Wi-Fi", "x": 1}}, {"tool": "get_contact_info", "arguments": {"name": "chị_Lan", "key": "phone"}, "status": "s"}, {"tool": "dial", "arguments": {}, "requires_confirmation": False},
        {"tool": "fly", "requires_confirmation": None}, "no call", {"tool": "get_contact_info", "arguments": [1]},
    ]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(said)], "id int, j string").withColumn("prediction", F.parse_json("j"))
    tools = jobs.read_catalog(spark, str(files / "tools.json"))
    get = lambda **more: {r.id: json.loads(r.p) for r in jobs.post_process(rows, tools, **more).select("id", F.to_json("prediction").alias("p")).collect()}
    mended = get()
    assert mended[0]["arguments"] == {"setting_type": "wifi", "x": 1} and mended[1] == {"tool": "get_contact_info", "arguments": {"name": "Lan", "key": "phone"}, "status": "s"}
    assert [mended[i] for i in (2, 3, 4, 5)] == said[2:]
    only = get(fix_confirmation=True, confirmation_only=True)
    assert only[0]["arguments"]["setting_type"] == "Wi-Fi" and only[0]["requires_confirmation"] is False and only[2]["requires_confirmation"] is True and only[3] == said[3]


def test_check_items(spark, tmp_path):
    item = {"id": "v1", "utterance": "mở bản đồ", "language": "vi", "intent": "open_map", "arguments": {"destination": "x"}, "risk_level": "low", "split": "train"}
    (tmp_path / "items.jsonl").write_text("\n".join(json.dumps(x) for x in (item, item | {"utterance": "khác"})), encoding="utf-8")
    assert list(jobs.check_items(spark, str(tmp_path / "items.jsonl"))) == ["line 2: duplicate id v1"]
    (tmp_path / "many.jsonl").write_text("[]\n" * 3000)
    messages = list(jobs.check_items(spark, str(tmp_path / "many.jsonl")))  # none is left out
    assert [int(m.split()[1].rstrip(":")) for m in messages if m.startswith("line ")] == sorted(int(m.split()[1].rstrip(":")) for m in messages) and len({m.split()[1] for m in messages}) == 3000
