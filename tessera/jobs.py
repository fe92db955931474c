"""Whole runs: evaluation of predictions, routing of queries to calls, validation of labelled items.

``python -m tessera evaluate|route|validate --help`` runs them from a shell.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import canonical_value, contact_name, extract_json
from tessera.operators import baselines, metrics, retrieve, validate
from tessera.operators.layout import kept
from tessera.sources import io
from tessera.streaming.resume import pending, resume_faults

CATALOG_FILE = "name string, description_vi string, description_en string, confirmation boolean, arguments map<string,struct<type:string,required:boolean,enum:array<string>,minimum:bigint,maximum:bigint,items:string>>"

#: What a setting may be called, and tools whose argument ``name`` is a person's.
SETTING_NAMES = {
    "ble": "bluetooth", "blue_tooth": "bluetooth", "bt": "bluetooth", "wi-fi": "wifi", "wi_fi": "wifi", "wireless": "wifi", "network": "mobile", "cellular": "mobile", "data": "mobile",
    "volume": "sound", "audio": "sound", "screen": "display", "brightness": "display", "power": "battery", "app": "storage", "privacy": "security", "gps": "location", "a11y": "accessibility",
    "locale": "language", "dev": "developer", "info": "about",
}
NAMED_TOOLS = ("get_contact_info", "make_phone_call")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of tools, with ``args`` as the validator wants them; arguments keep their order."""
    tools = io.read_json_document(spark, path, CATALOG_FILE)
    made = F.transform(F.map_entries("arguments"), lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), F.coalesce(e["value"]["required"], F.lit(False)).alias("required"), *[e["value"][c].alias(c) for c in ("enum", "minimum", "maximum", "items")]))
    return tools.withColumn("args", F.coalesce(made, F.array().cast(validate.CATALOG_SCHEMA.split("args ")[1])))


def _examples(spark: SparkSession, path: str) -> DataFrame:
    rows = io.read_jsonl(spark, path)
    get = lambda f, t="string": F.try_variant_get("row", f"$.{f}", t)
    return rows.select(get("id").alias("id"), "line_no", get("group").alias("group"), get("query").alias("query"), get("expected", "variant").alias("expected"))


def _predictions(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    rows = io.read_jsonl(spark, path, mode)
    whole = F.coalesce(F.try_variant_get("row", "$.prediction", "variant"), F.col("row"))
    return rows.select(F.try_variant_get("row", "$.id", "string").alias("id"), "line_no", whole.alias("prediction"), F.try_variant_get("row", "$.protocol_id", "string").alias("protocol_id"))


def evaluate(spark: SparkSession, predictions: str, examples: str, catalog: str, out: str, allow_partial: bool = False) -> DataFrame:
    """The scorer's report: as JSON in ``out``/report, as Markdown in ``out``/tables, and the failed examples as CSV in ``out``/errors.

    Examples without a prediction, and predictions of unknown examples, are an
    error unless ``allow_partial``.
    """
    gold, guess = _examples(spark, examples), _predictions(spark, predictions)
    if not allow_partial:
        odd = metrics.missing_and_extra(gold, guess, "id").groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()
        if odd:
            raise ValueError("incomplete predictions: " + ", ".join(f"{r.n} {r.side}" for r in odd))
    scored = kept(metrics.score_examples(gold.drop("query"), guess, read_catalog(spark, catalog)))
    report = kept(metrics.report(scored))
    io.write_report(report, f"{out}/report")
    tables = [
        io.markdown(report, "Groups"), io.markdown(metrics.field_accuracy(scored).orderBy("field"), "Arguments"), io.markdown(metrics.negative_accuracy(scored), "Examples without a tool"),
        io.markdown(metrics.confusion(scored, [F.col("exp_tool")], [F.col("act_tool")]).filter("expected != predicted"), "Confusions"),
    ]
    spark.createDataFrame([("\n".join(tables),)], "value string").coalesce(1).write.text(f"{out}/tables")
    failed = scored.filter("not end_to_end").select("id", "group", F.col("exp_tool").alias("expected_tool"), F.col("act_tool").alias("predicted_tool"), metrics.error_type().alias("error_type"), F.to_json("expected").alias("expected"), F.to_json("prediction").alias("prediction"), F.array_join("errors", "; ").alias("schema_errors"))
    io.write_csv(failed, f"{out}/errors")
    return report


def _with(call: Column, **members: Column) -> Column:
    """An object variant with some members replaced; ``members`` are JSON texts, null leaves the member as it is."""
    given = F.coalesce(F.try_variant_get(call, "$", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    new = F.map_filter(F.create_map(*[x for n, c in members.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())
    old = F.map_filter(given, lambda k, _: ~F.map_contains_key(new, k))
    pairs = F.concat(F.transform(F.map_entries(old), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value"))), F.map_entries(new))
    return F.parse_json(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(baselines._json(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}")))


def post_process(rows: DataFrame, catalog: DataFrame, fix_confirmation: bool = False, confirmation_only: bool = False, settings: dict[str, str] = SETTING_NAMES) -> DataFrame:
    """What a model said, mended: names of settings and persons, unless ``confirmation_only``; confirmation from the catalog, if asked for."""
    p = F.col("prediction")
    get = lambda path: F.try_variant_get("prediction", path, "string")
    if not confirmation_only:
        setting = F.when((get("$.tool") == "open_settings") & (F.coalesce(get("$.arguments.setting_type"), F.lit("")) != ""), baselines._json(canonical_value(get("$.arguments.setting_type"), settings)))
        person = F.when(get("$.tool").isin(*NAMED_TOOLS) & (validate.kind_of(F.try_variant_get("prediction", "$.arguments.name", "variant")) == "string"), baselines._json(contact_name(get("$.arguments.name"))))
        arguments = F.when(setting.isNotNull() | person.isNotNull(), F.to_json(_with(F.try_variant_get("prediction", "$.arguments", "variant"), setting_type=setting, name=person)))
        rows = rows.withColumn("prediction", F.when(arguments.isNotNull(), _with(p, arguments=arguments)).otherwise(p))
    if fix_confirmation:
        known = validate.small(catalog.select(F.col("name").alias("__tool"), F.col("confirmation").alias("__confirmation")))
        rows = rows.join(known, get("$.tool") == F.col("__tool"), "left")
        rows = rows.withColumn("prediction", F.when(F.col("__tool").isNotNull(), _with(p, requires_confirmation=F.col("__confirmation").cast("string"))).otherwise(p)).drop("__tool", "__confirmation")
    return rows


def route(
    spark: SparkSession, examples: str, catalog: str, out: str, predictor: baselines.Predictor | None = None, retriever: retrieve.Retriever | None = None, top_k: int = 5,
    resume: bool = False, protocol_id: str | None = None, fix_confirmation: bool = False, confirmation_only: bool = False, task_ids: Sequence[str] = (),
) -> DataFrame:
    """Queries to calls: rank tools, build prompts, predict, mend, append JSON lines to ``out``; returns what this call appended.

    ``predictor`` gets id, query, retrieved_tools and prompt, and adds
    ``prediction`` or ``raw_output``; by default the rules.  With ``resume`` the
    ids that ``out`` has are skipped; repeated or unknown ids there, or another
    protocol, are an error.  With ``task_ids`` only these are routed.
    """
    tools = read_catalog(spark, catalog)
    asked = metrics.last_wins(_examples(spark, examples).select("id", "line_no", "query")).select("id", "query")
    if resume and _exists(spark, out):
        done = _predictions(spark, out, "resume")
        faults = resume_faults(asked, done if protocol_id else done.drop("protocol_id"), protocol="protocol_id").collect()
        other = [r.protocol_id for r in done.select("protocol_id").distinct().collect() if protocol_id and r.protocol_id != protocol_id]
        if faults or other:
            raise ValueError(f"can't resume: {[tuple(f) for f in faults[:5]]} {other[:5]}")
        asked = pending(asked, done)
    if task_ids:
        asked = asked.filter(F.col("id").isin(*task_ids))
    items = tools.select(F.col("name").alias("item"), retrieve.tool_text(F.col("name"), F.col("description_vi"), F.col("description_en"), arguments=F.map_keys("arguments")).alias("text"))
    retriever = retriever or retrieve.Bm25Retriever(items)
    queries = asked.select(F.col("id").alias("query"), F.col("query").alias("text"))
    scores = retrieve.fill_zero(retriever.scores(queries).select("query", "item", "score"), queries, items)
    best = retrieve.rank(scores, top_k).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("retrieved_tools"))
    rows = asked.join(best.withColumnRenamed("query", "__id"), F.col("id") == F.col("__id"), "left").drop("__id")
    rows = rows.withColumn("prompt", retrieve.prompt(F.col("retrieved_tools"), F.col("query")))
    said = (predictor or baselines.rule_predictor("query"))(rows)
    if "prediction" not in said.columns:
        said = said.withColumn("prediction", extract_json(F.col("raw_output")))
    said = post_process(said, tools, fix_confirmation, confirmation_only)
    extra = [c for c in ("raw_output", "latency_ms") if c in said.columns]
    # Written first: what is appended and what is returned are one and the same predictions.
    made = kept(said.select("id", "prediction", "retrieved_tools", *extra, F.lit(protocol_id).cast("string").alias("protocol_id")))
    io.write_jsonl(made, out, append=True)
    return made


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def check_items(spark: SparkSession, path: str) -> Iterator[str]:
    """All messages of a file of labelled items, in the order of lines; none if all are sound.  The driver holds a partition of them at a time."""
    rows = io.read_jsonl(spark, path).select("line_no", F.col("row").alias("item"))
    for r in validate.validate_items(rows).orderBy("line_no", "ord").toLocalIterator():
        yield f"line {r.line_no}: {r.message}"


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__.splitlines()[0])
    sub = parser.add_subparsers(dest="job", required=True)
    one = sub.add_parser("evaluate", help="score predictions")
    for name in ("predictions", "examples", "catalog", "out"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--allow-partial", action="store_true")
    two = sub.add_parser("route", help="queries to calls, by the rules")
    for name in ("examples", "catalog", "out"):
        two.add_argument(f"--{name}", required=True)
    two.add_argument("--top-k", type=int, default=5)
    two.add_argument("--protocol-id")
    two.add_argument("--task-id", action="append", default=[], help="route these examples only; may be given several times")
    for name in ("resume", "fix-confirmation", "confirmation-only-postprocessing"):
        two.add_argument(f"--{name}", action="store_true")
    three = sub.add_parser("validate", help="check labelled items")
    three.add_argument("--items", required=True)
    three.add_argument("--summarize", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"tessera-{args.job}").getOrCreate()
    if args.job == "evaluate":
        found = evaluate(spark, args.predictions, args.examples, args.catalog, args.out, args.allow_partial)
        print(json.dumps(found.first().asDict(), ensure_ascii=False))
        return 0
    if args.job == "route":
        made = route(spark, args.examples, args.catalog, args.out, top_k=args.top_k, resume=args.resume, protocol_id=args.protocol_id, fix_confirmation=args.fix_confirmation, confirmation_only=args.confirmation_only_postprocessing, task_ids=args.task_id)
        print(json.dumps({"columns": made.columns, "out": args.out}))
        return 0
    faulty = False
    for message in check_items(spark, args.items):
        faulty = True
        print(message)
    if args.summarize:
        items = io.read_jsonl(spark, args.items).select(*[F.try_variant_get("row", f"$.{c}", "string").alias(c) for c in ("intent", "split", "risk_level", "utterance")])
        for r in validate.summarize_items(items, ["intent", "split", "risk_level"], "utterance").orderBy("dimension", "value").collect():
            print(f"{r.dimension}\t{r.value}\t{r.n:g}")
    return 1 if faulty else 0
