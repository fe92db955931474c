"""Row validation: JSON types, tool calls, labelled items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize

# The statuses that allow a call without a tool.
NULL_STATUSES = ("clarification", "unsupported", "rejected")

CATALOG_ROWS = 10_000


def small(table: DataFrame, most: int = CATALOG_ROWS) -> DataFrame:
    """The table with a broadcast hint, if it has at most ``most`` rows."""
    n = table.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows can't be sent to every task")
    return F.broadcast(table)


CATALOG_SCHEMA = "name string, confirmation boolean, args array<struct<name:string,type:string,required:boolean,enum:array<string>,minimum:bigint,maximum:bigint,items:string>>"


def kind_of(value: Column) -> Column:
    """V1: string, integer, number, boolean, array, object or null, of a variant; null if it is missing."""
    s = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string")).when(s == "STRING", "string").when(s == "BIGINT", "integer").when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s == "VOID", "null").otherwise("number")
    )


def _absent(value: Column) -> Column:
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))


def _one(condition: Column, message: Column) -> Column:
    return F.when(condition, F.array(message)).otherwise(F.array().cast("array<string>"))


def _argument_errors(arg: Column, given: Column) -> Column:
    """V6-V8: of one argument; a missing or mistyped one has no further errors."""
    value = F.try_element_at(given, arg["name"])
    name, kind = arg["name"], arg["type"]
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "bigint")
    items = F.try_variant_get(value, "$", "array<variant>")
    rest = F.concat(
        _one(arg["enum"].isNotNull() & ~F.coalesce(F.array_contains(arg["enum"], text), F.lit(False)), F.concat(name, F.lit(" is outside enum"))),
        _one((kind == "integer") & arg["minimum"].isNotNull() & (number < arg["minimum"]), F.concat(name, F.lit(" is below minimum"))),
        _one((kind == "integer") & arg["maximum"].isNotNull() & (number > arg["maximum"]), F.concat(name, F.lit(" is above maximum"))),
        _one((kind == "array") & arg["items"].isNotNull() & F.exists(items, lambda x: ~kind_of(x).eqNullSafe(arg["items"])), F.concat(name, F.lit(" contains invalid item type"))),
    )
    return (
        F.when(_absent(value), _one(arg["required"], F.concat(F.lit("missing required argument: "), name)))
        .when(~kind_of(value).eqNullSafe(kind), F.array(F.concat(name, F.lit(" must be "), kind)))
        .otherwise(rest)
    )


def validate_calls(calls: DataFrame, catalog: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Adds ``errors``, ordered; ``catalog`` as in CATALOG_SCHEMA.

    A call that is null or no object counts as an empty object.  The catalog is
    broadcast; one of more than CATALOG_ROWS tools is an error.
    """
    p = F.col(prediction)
    tool = F.try_variant_get(p, "$.tool", "string")
    status = F.try_variant_get(p, "$.status", "string")
    arguments = F.try_variant_get(p, "$.arguments", "variant")
    joined = calls.withColumn("__tool", tool).join(
        small(catalog.select(F.col("name").alias("__name"), F.col("confirmation").alias("__confirmation"), F.col("args").alias("__args"))), F.col("__tool") == F.col("__name"), "left"
    )
    given = F.try_variant_get(p, "$.arguments", "map<string,variant>")
    unknown = F.array_sort(F.array_except(F.map_keys(given), F.transform("__args", lambda a: a["name"])))
    confirmed = F.coalesce(F.try_variant_get(p, "$.requires_confirmation", "boolean"), F.lit(None).cast("boolean"))
    wanted = F.coalesce(F.col("__confirmation"), F.lit(False))
    errors = (
        F.when(F.col("__tool").isNull(), _one(~F.coalesce(status.isin(*NULL_STATUSES), F.lit(False)), F.lit("null tool requires clarification, unsupported or rejected status")))
        .when(F.col("__name").isNull(), F.array(F.concat(F.lit("unknown tool: "), F.col("__tool"))))
        .when(~kind_of(arguments).eqNullSafe("object"), F.array(F.lit("arguments must be an object")))
        .otherwise(F.concat(
            _one(F.size(unknown) > 0, F.concat(F.lit("unknown arguments: "), F.array_join(unknown, ", "))),
            F.flatten(F.transform("__args", lambda a: _argument_errors(a, given))),
            _one(~confirmed.eqNullSafe(wanted), F.concat(F.lit("requires_confirmation must be "), wanted.cast("string"))),
        ))
    )
    return joined.withColumn("errors", errors).drop("__tool", "__name", "__confirmation", "__args")


def policy_cases(cases: DataFrame) -> DataFrame:
    """(errors, must_contain, must_be_valid) adds ``passed``: each expected part is in some error."""
    found = F.forall(F.coalesce("must_contain", F.array().cast("array<string>")), lambda m: F.exists("errors", lambda e: F.contains(e, m)))
    return cases.withColumn("passed", found & (~F.coalesce("must_be_valid", F.lit(False)) | (F.size("errors") == 0)))


def duplicates(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``occurrence`` (from 1 in ``order``) and ``is_duplicate``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("occurrence", F.row_number().over(w).cast("bigint")).withColumn("is_duplicate", F.col("occurrence") > 1)


def split_leaks(rows: DataFrame, key: str, split: str, order: Sequence[str]) -> DataFrame:
    """Rows whose key was last seen in another split; adds ``previous``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("previous", F.lag(split).over(w)).filter((F.col("previous") != "") & (F.col("previous") != F.col(split)))


def required_groups(given: Column, groups: Sequence[Sequence[str]]) -> Column:
    """For a map<string, string>, the OR-groups none of whose keys has a value, joined by /."""
    missing = [F.when(~sum((F.coalesce(F.try_element_at(given, F.lit(k)) != "", F.lit(False)).cast("int") for k in g), F.lit(0)).cast("boolean"), "/".join(g)) for g in groups]
    return F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>")


#: The labelled items' intents and what their arguments must hold.
INTENTS = ("set_alarm", "set_timer", "call_contact", "send_sms", "open_map", "open_app", "unsupported", "clarify")
REQUIRED_ARGS: dict[str, tuple[tuple[str, ...], ...]] = {
    "set_alarm": (("hour",),), "set_timer": (("duration_minutes", "seconds"),), "call_contact": (("contact",),),
    "send_sms": (("contact",), ("message",)), "open_map": (("destination",),), "open_app": (("app_name",),),
}
ITEM_FIELDS = ("id", "utterance", "language", "intent", "arguments", "risk_level", "split")


def validate_items(items: DataFrame, intents: Sequence[str] = INTENTS, required: Mapping[str, Sequence[Sequence[str]]] = REQUIRED_ARGS) -> DataFrame:
    """``items`` (line_no, item variant) to (line_no, ord, message), the messages in their order.

    Rows that lack a field aren't looked at further; rows whose arguments are no
    object count for ids and intents, but not for leaks between splits.
    """
    get = lambda f, t="string": F.try_variant_get("item", f"$.{f}", t)
    lacking = F.array_compact(F.array(*[F.when(F.try_variant_get("item", f"$.{f}", "variant").isNull(), F.lit(f)) for f in ITEM_FIELDS]))
    rows = items.withColumn("lacking", lacking).withColumns({f: get(f) for f in ("id", "utterance", "intent", "split")})
    whole = rows.filter(F.size("lacking") == 0)
    whole = duplicates(whole, ["id"], ["line_no"]).withColumn("args", get("arguments", "variant"))
    whole = whole.withColumn("is_object", kind_of(F.col("args")) == "object").withColumn("norm", normalize(F.col("utterance"), "student"))
    w = Window.partitionBy("is_object", "norm").orderBy("line_no")
    whole = whole.withColumn("previous", F.when(F.col("is_object"), F.lag("split").over(w)))
    given = F.try_variant_get("args", "$", "map<string,variant>")
    has = lambda k: ~_absent(F.try_element_at(given, F.lit(k))) & ~F.coalesce(F.try_variant_get(F.try_element_at(given, F.lit(k)), "$", "string") == "", F.lit(False))
    found = [
        F.when(F.col("is_duplicate"), F.concat(F.lit("duplicate id "), F.col("id"))),
        F.when(~F.col("intent").isin(*intents), F.lit("unknown intent")),
        F.when(~F.col("is_object"), F.lit("arguments must be an object")),
    ]
    for intent, groups in required.items():
        for g in groups:
            some = has(g[0])
            for k in g[1:]:
                some = some | has(k)
            found.append(F.when(F.col("is_object") & (F.col("intent") == intent) & ~some, F.lit(f"{intent} lacks {'/'.join(g)}")))
    named = F.try_element_at(given, F.lit("missing"))
    empty = _absent(named) | F.to_json(named).isin("[]", "{}", '""', "0", "false")
    found.append(F.when(F.col("is_object") & (F.col("intent") == "clarify") & empty, F.lit("clarify must name what is missing")))
    found.append(F.when((F.col("previous") != "") & (F.col("previous") != F.col("split")), F.concat(F.lit("utterance leaks between splits "), F.col("previous"), F.lit(" and "), F.col("split"))))
    of_whole = whole.select("line_no", F.posexplode(F.array_compact(F.array(*found))).alias("ord", "message"))
    of_lacking = rows.select("line_no", F.posexplode(F.transform("lacking", lambda f: F.concat(F.lit("lacks "), f))).alias("ord", "message"))
    return of_lacking.unionByName(of_whole)


def summarize_items(items: DataFrame, dimensions: Sequence[str], text: str, kind: str = "student") -> DataFrame:
    """(dimension, value, n) for each dimension, and n and the rate of distinct normalised texts."""
    counts = items.groupingSets([[d] for d in dimensions], *dimensions).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"__{d}") for d in dimensions])
    name = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"__{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("None"))) for d in dimensions])
    counts = counts.select(name.alias("dimension"), value.alias("value"), F.col("n").cast("double").alias("n"))
    rate = items.select(normalize(F.col(text), kind).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("d"))
    total = rate.select(F.lit("all").alias("dimension"), F.lit("n").alias("value"), F.col("n").cast("double").alias("n"))
    unique = rate.select(F.lit("all").alias("dimension"), F.lit("unique_rate").alias("value"), F.coalesce(F.round(F.col("d") / F.nullif(F.col("n"), F.lit(0)), 3), F.lit(0.0)).alias("n"))
    return counts.unionByName(total).unionByName(unique)


def validate_protocol(tasks: DataFrame, catalog: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """Tasks (id, query, expected variant) to (id, message): repeated or empty ids and queries, forbidden tools, invalid calls."""
    marked = duplicates(tasks, ["id"], ["query"]).withColumnRenamed("is_duplicate", "same_id").drop("occurrence")
    marked = duplicates(marked, ["query"], ["id"]).withColumnRenamed("is_duplicate", "same_query")
    checked = validate_calls(marked, catalog, "expected")
    tool = F.try_variant_get("expected", "$.tool", "string")
    messages = F.concat(
        _one(F.coalesce("id", F.lit("")) == "", F.lit("empty id")), _one(F.coalesce("query", F.lit("")) == "", F.lit("empty query")),
        _one(F.col("same_id"), F.lit("repeated id")), _one(F.col("same_query"), F.lit("repeated query")),
        _one(F.coalesce(tool.isin(*forbidden), F.lit(False)) if forbidden else F.lit(False), F.lit("forbidden tool")), F.col("errors"),
    )
    return checked.select("id", F.explode(messages).alias("message"))


def decoding_schema(catalog: DataFrame) -> DataFrame:
    """The catalog as what a constrained decoder may emit: one row a tool with its argument names and enums."""
    return catalog.select("name", F.transform("args", lambda a: F.struct(a["name"].alias("name"), a["type"].alias("type"), a["enum"].alias("enum"))).alias("args"), F.filter("args", lambda a: a["required"]).getField("name").alias("required"))


#: V22. What the schema document of labelled items allows.
ITEM_LANGUAGES = ("vi", "vi-en")
RISK_LEVELS = ("low", "medium", "high")
SPLITS = ("train", "validation", "test", "test_ood", "test_ambiguous")
UTTERANCE_LENGTH = 2


def schema_faults(items: DataFrame) -> DataFrame:
    """(line_no, field) of the items' values that the schema document forbids and ``validate_items`` doesn't look at."""
    get = lambda f: F.try_variant_get("item", f"$.{f}", "string")
    outside = lambda f, allowed: F.when(get(f).isNotNull() & ~get(f).isin(*allowed), f)
    found = F.array_compact(F.array(
        F.when(F.char_length(get("utterance")) < UTTERANCE_LENGTH, F.lit("utterance")), outside("language", ITEM_LANGUAGES), outside("risk_level", RISK_LEVELS), outside("split", SPLITS), outside("intent", INTENTS),
    ))
    return items.select("line_no", F.explode(found).alias("field"))


def validate_candidate(items: DataFrame, candidate: DataFrame) -> DataFrame:
    """The messages of one new item (item variant), judged as if it stood behind all others."""
    last = items.agg(F.coalesce(F.max("line_no"), F.lit(0)).alias("last"))
    new = candidate.select("item").crossJoin(F.broadcast(last)).select((F.col("last") + 1).alias("line_no"), "item")
    found = validate_items(items.select("line_no", "item").unionByName(new), INTENTS, REQUIRED_ARGS)
    return found.join(F.broadcast(new.select("line_no")), "line_no").select("ord", "message")
