"""Scoring of predictions against labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import mcnemar_exact, mcnemar_z, ratio, wilson, wilson_text
from tessera.functions.text import contact_name, normalize, phone_digits
from tessera.operators.validate import kind_of, small, validate_calls


def last_wins(rows: DataFrame, key: str = "id", order: str = "line_no") -> DataFrame:
    """Of rows with equal keys the one of the highest order."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in columns])


def _text(value: Column) -> Column:
    """A variant as the text that a dynamic language prints for it."""
    kind = kind_of(value)
    return (
        F.when(value.isNull() | (kind == "null"), F.lit("None")).when(kind == "boolean", F.initcap(F.try_variant_get(value, "$", "string")))
        .when(kind == "string", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    )


def _number(value: Column) -> Column:
    """Of a number or boolean; null of anything else, also of text that looks like one."""
    kind = kind_of(value)
    return F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))


def values_match(name: Column, expected: Column, actual: Column, depth: int = 4) -> Column:
    """A1: the comparison of one argument; objects to ``depth`` levels, deeper ones by their JSON text."""
    kind = kind_of(expected)
    exp_map, act_map = (F.try_variant_get(v, "$", "map<string,variant>") for v in (expected, actual))
    if depth:
        nested = F.forall(F.map_keys(exp_map), lambda k: F.coalesce(F.map_contains_key(act_map, k), F.lit(False)) & values_match(k, F.element_at(exp_map, k), F.try_element_at(act_map, k), depth - 1))
    else:
        nested = F.to_json(expected) == F.to_json(actual)
    exp_list, act_list = (F.try_variant_get(v, "$", "array<variant>") for v in (expected, actual))
    sorted_texts = lambda v: F.array_sort(F.transform(v, lambda x: normalize(_text(x))))
    e, a = _text(expected), _text(actual)
    matched = (
        F.when(kind == "object", (kind_of(actual) == "object") & nested)
        .when(kind == "array", (kind_of(actual) == "array") & (F.size(exp_list) == F.size(act_list)) & (sorted_texts(exp_list) == sorted_texts(act_list)))
        .when(kind.isin("boolean", "integer"), _number(expected) == _number(actual))
        .when(F.lower(name).contains("phone"), phone_digits(e) == phone_digits(a))
        .when(F.lower(name) == "name", contact_name(normalize(e)) == contact_name(normalize(a)))
        .otherwise(normalize(e) == normalize(a))
    )
    return F.coalesce(matched, F.lit(False))


def score_examples(examples: DataFrame, predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per example.

    ``examples``: id, line_no, group, expected variant.  ``predictions``: id,
    line_no, prediction variant (null: missing).  Of repeated ids the last wins;
    a missing prediction is an empty object.
    """
    gold = last_wins(examples.select("id", "line_no", "group", "expected"))
    guess = last_wins(predictions.select("id", "line_no", "prediction")).select("id", "prediction")
    rows = gold.join(guess, "id", "left").withColumn("prediction", F.coalesce("prediction", F.parse_json(F.lit("{}"))))
    needs = catalog.select(F.col("name").alias("__tool"), F.filter("args", lambda a: a["required"]).getField("name").alias("required"))
    rows = validate_calls(rows, catalog).join(small(needs), F.try_variant_get("expected", "$.tool", "string") == F.col("__tool"), "left").drop("__tool")
    get = lambda v, f, t="string": F.try_variant_get(v, f"$.{f}", t)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    exp, act = (F.coalesce(get(v, "arguments", "map<string,variant>"), none) for v in ("expected", "prediction"))
    rows = rows.withColumns({"exp_args": exp, "act_args": act, "exp_tool": get("expected", "tool"), "act_tool": get("prediction", "tool"), "exp_status": get("expected", "status"), "act_status": get("prediction", "status")})
    hit = F.filter(F.map_keys("exp_args"), lambda k: F.coalesce(F.map_contains_key("act_args", k), F.lit(False)) & values_match(k, F.element_at("exp_args", k), F.try_element_at("act_args", k)))
    rows = rows.withColumns({"args_correct": F.size(hit), "args_total": F.size("exp_args")})
    same_keys = F.array_sort(F.map_keys("exp_args")) == F.array_sort(F.map_keys("act_args"))
    rows = rows.withColumns({
        "tool_correct": F.col("exp_tool").eqNullSafe(F.col("act_tool")),
        "arguments_exact": (F.col("args_correct") == F.col("args_total")) & same_keys,
        "schema_valid": F.size("errors") == 0,
        "status_correct": F.col("exp_tool").isNotNull() | (F.col("act_tool").isNull() & F.col("exp_status").eqNullSafe(F.col("act_status"))),
        "confirmation_correct": get("expected", "requires_confirmation", "boolean").eqNullSafe(get("prediction", "requires_confirmation", "boolean")),
    })
    e2e = F.col("tool_correct") & F.col("arguments_exact") & F.col("status_correct") & F.col("confirmation_correct") & F.col("schema_valid")
    return rows.withColumn("end_to_end", e2e).withColumn("group", F.coalesce("group", F.lit("unknown")))




def _lenient(expected: Column, actual: Column) -> Column:
    """Equal as values, texts without their case."""
    both = lambda kinds: kind_of(expected).isin(*kinds) & kind_of(actual).isin(*kinds)
    equal = (
        F.when(both(["string"]), F.lower(_text(expected)) == F.lower(_text(actual)))
        .when(both(["boolean", "integer", "number"]), _number(expected) == _number(actual))
        .otherwise(F.to_json(expected) == F.to_json(actual))
    )
    return F.coalesce(equal, F.lit(False))


def end_to_end_variants() -> dict[str, Column]:
    """The definitions of end-to-end success, over ``score_examples``; ``canonical`` is the default everywhere.

    ``required_filled`` asks that the arguments which the catalog requires are
    there; ``cs_fix`` is the same on other rows, see ``success_of_predictions``.
    """
    status = lambda v: F.try_variant_get(v, "$.status", "string")
    confirmed = lambda v: F.try_variant_get(v, "$.requires_confirmation", "boolean")
    keys = F.map_keys("exp_args")
    superset = F.size(F.array_except(keys, F.map_keys("act_args"))) == 0
    loose_status = F.col("exp_tool").isNotNull() | F.col("act_tool").isNull() | F.col("exp_status").eqNullSafe(F.col("act_status"))
    text = lambda k: F.coalesce(F.nullif(_text(F.try_element_at("act_args", k)), F.lit("None")), F.lit(""))
    filled = F.forall(F.coalesce("required", F.array().cast("array<string>")), lambda k: text(k) != "")
    given = F.forall(keys, lambda k: _lenient(F.element_at("exp_args", k), F.try_element_at("act_args", k)))
    asked = F.coalesce(F.col("exp_status"), F.lit("")) != ""
    tool = F.col("tool_correct")
    confirmation = confirmed("expected").isNull() | confirmed("expected").eqNullSafe(confirmed("prediction"))
    return {
        "canonical": F.col("end_to_end"),
        "custom": tool & (F.col("args_correct") == F.col("args_total")) & superset & loose_status & F.col("confirmation_correct") & F.col("schema_valid"),
        "required_filled": tool & (F.col("exp_tool").isNull() | filled),
        "lenient_confirmed": tool & F.when(F.col("exp_tool").isNull(), status("expected").eqNullSafe(status("prediction"))).otherwise(given & confirmation),
        "lenient_status": tool & given & (~asked | F.col("exp_status").eqNullSafe(F.col("act_status"))),
    }


def soft_containment() -> Column:
    """Of one row: the share of required arguments one of whose texts holds the other; 1 if none is required, 0 for another tool."""
    plain = lambda side, k: F.lower(F.trim(_text(F.try_element_at(side, k))))
    present = lambda side, k: F.try_element_at(side, k).isNotNull() & (plain(side, k) != "")
    hit = F.filter(F.coalesce("required", F.array().cast("array<string>")), lambda k: present("act_args", k) & present("exp_args", k) & (F.contains(plain("exp_args", k), plain("act_args", k)) | F.contains(plain("act_args", k), plain("exp_args", k))))
    return F.when(~F.col("tool_correct"), 0.0).when(F.col("exp_tool").isNull() | (F.coalesce(F.size("required"), F.lit(0)) <= 0), 1.0).otherwise(F.size(hit) / F.size("required"))


def success_of_predictions(examples: DataFrame, predictions: DataFrame, catalog: DataFrame) -> DataFrame:
    """The variant ``cs_fix``: (count, tool_acc, schema_valid, e2e) with one row a prediction.

    Every prediction counts, repeated ones and those without an example too;
    confirmation isn't asked for, as it would be set from the catalog.
    """
    gold = last_wins(examples.select("id", "line_no", "expected")).select("id", "expected")
    needs = catalog.select(F.col("name").alias("__tool"), F.filter("args", lambda a: a["required"]).getField("name").alias("required"))
    rows = predictions.select("id", "prediction").join(gold, "id", "left").withColumn("exp_tool", F.try_variant_get("expected", "$.tool", "string"))
    rows = rows.join(small(needs), F.col("exp_tool") == F.col("__tool"), "left")
    given = F.try_variant_get("prediction", "$.arguments", "map<string,variant>")
    filled = F.forall(F.coalesce("required", F.array().cast("array<string>")), lambda k: F.coalesce(F.nullif(_text(F.try_element_at(given, k)), F.lit("None")), F.lit("")) != "")
    tool = F.col("expected").isNotNull() & F.col("exp_tool").eqNullSafe(F.try_variant_get("prediction", "$.tool", "string"))
    ok = tool & (F.col("exp_tool").isNull() | F.coalesce(filled, F.coalesce(F.size("required"), F.lit(0)) <= 0))
    rate = lambda c: ratio(F.count_if(c), F.count(F.lit(1)), 0.0)
    return rows.agg(F.count(F.lit(1)).alias("count"), rate(tool).alias("tool_acc"), rate(ok).alias("schema_valid"), rate(ok).alias("e2e"))


def negative_accuracy(scored: DataFrame) -> DataFrame:
    """A15, A16 over examples without a tool, 1 if there are none: tool and status right, and the status alone; confirmation over all."""
    null = F.col("exp_tool").isNull()
    of_null = lambda c: ratio(F.count_if(null & c), F.count_if(null), 1.0)
    return scored.agg(
        F.count_if(null).cast("bigint").alias("n_null"), of_null(F.col("status_correct")).alias("null_status_accuracy"),
        of_null(F.col("exp_status").eqNullSafe(F.col("act_status"))).alias("status_only_accuracy"),
        ratio(F.count_if(F.col("confirmation_correct")), F.count(F.lit(1)), 1.0).alias("confirmation_accuracy"),
    )


def pilot_summary(tasks: DataFrame, records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tasks`` (id, supported), ``records`` (id, flags): counts and rates, each of its own denominator.

    Records of unknown tasks are left out (J15); null flags count as false.
    """
    done = records.join(tasks.select("id", "supported"), "id")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    supported, right = F.col("supported"), flag("tool_correct")
    n, n_supported, n_negative = F.count(F.lit(1)), F.count_if(supported), F.count_if(~supported)
    predicted = right & F.when(supported, flag("arguments_correct")).otherwise(flag("status_correct"))
    safe = ~supported & flag("execute_disabled") & flag("no_external_launch") & right & flag("status_correct")
    full = F.count_if(flag("full_execution_success"))
    low, high = wilson(full, n)
    out = done.groupBy(*by).agg(
        n.alias("completed_tasks"), full.alias("full_execution_successes"), ratio(full, n, 0.0).alias("execution_accuracy"), low.alias("low"), high.alias("high"),
        F.count_if(predicted).alias("prediction_successes"), ratio(F.count_if(predicted), n, 0.0).alias("prediction_accuracy"),
        n_supported.alias("supported_tasks"), ratio(F.count_if(supported & flag("launch_success")), n_supported, 0.0).alias("activity_launch_rate"),
        ratio(F.count_if(supported & flag("semantic_success")), n_supported, 0.0).alias("semantic_success_rate"),
        n_negative.alias("negative_tasks"), F.count_if(safe).alias("negative_safety_successes"), ratio(F.count_if(safe), n_negative, 0.0).alias("negative_safety_rate"),
    )
    if by:
        return out
    planned = tasks.agg(F.count(F.lit(1)).alias("planned_tasks"))
    return F.broadcast(planned).crossJoin(out).withColumn("complete", F.col("planned_tasks") == F.col("completed_tasks"))


def pilot_success() -> Column:
    """What counts as full success of a record, by whether its task has a tool."""
    return F.when(F.col("supported"), all_true(*[F.col(c) for c in ("tool_correct", "arguments_correct", "confirmation_correct", "launch_success", "semantic_success")])).otherwise(
        all_true(*[F.col(c) for c in ("tool_correct", "status_correct", "execute_disabled", "no_external_launch")])
    )


def class_order(label: Column) -> list[Column]:
    """O3: classes by name, those without a tool last."""
    return [F.startswith(label, F.lit("NULL:")), label]


def rates(rows: DataFrame, flags: Sequence[str], by: Sequence[str] = (), sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Count and the rate of each boolean, null as false, per group or grouping set."""
    aggs = [F.count(F.lit(1)).alias("count"), *[F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")).alias(f"{f}_rate") for f in flags]]
    if sets is not None:
        return rows.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(*aggs)
    return rows.groupBy(*by).agg(*aggs)


def report(scored: DataFrame) -> DataFrame:
    """The row of all examples and of each group; 0 examples give the empty report."""
    soft = ratio(F.sum("args_correct"), F.sum("args_total"), 1.0)
    aggs = [
        F.count(F.lit(1)).alias("count"),
        *[F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)).alias(n) for c, n in (("tool_correct", "tool_selection_accuracy"), ("schema_valid", "schema_valid_rate"), ("end_to_end", "end_to_end_task_success"))],
        soft.alias("soft_argument_accuracy"), wilson_text(F.coalesce(F.sum(F.col("end_to_end").cast("int")), F.lit(0)), F.count(F.lit(1))).alias("end_to_end_ci_95"),
    ]
    return scored.agg(*aggs).withColumn("group", F.lit(None).cast("string")).unionByName(scored.groupBy("group").agg(*aggs)).orderBy(F.col("group").asc_nulls_first())


def field_accuracy(scored: DataFrame) -> DataFrame:
    """Correct and total per expected argument."""
    each = scored.select(F.explode("exp_args").alias("field", "exp"), "act_args")
    hit = F.coalesce(F.map_contains_key("act_args", F.col("field")), F.lit(False)) & values_match(F.col("field"), F.col("exp"), F.try_element_at("act_args", F.col("field")))
    return each.groupBy("field").agg(F.sum(hit.cast("int")).alias("correct"), F.count(F.lit(1)).alias("total")).withColumn("accuracy", F.col("correct") / F.col("total"))


def confusion(rows: DataFrame, expected: Sequence[Column], predicted: Sequence[Column]) -> DataFrame:
    """Counts of (expected, predicted), nulls as None, most frequent first."""
    keys = [F.coalesce(c.cast("string"), F.lit("None")).alias(n) for c, n in [(c, f"expected{i or ''}") for i, c in enumerate(expected)] + [(c, f"predicted{i or ''}") for i, c in enumerate(predicted)]]
    names = [f"expected{i or ''}" for i in range(len(expected))] + [f"predicted{i or ''}" for i in range(len(predicted))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *names)


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first true condition."""
    out = None
    for condition, label in cases:
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise)


def error_type(detailed: bool = True) -> Column:
    """Both taxonomies, over the columns of ``score_examples``."""
    wrong = ~F.col("tool_correct")
    if detailed:
        cases = [
            (wrong & F.col("exp_tool").isNull(), "unsafe_or_unwanted_tool_for_null_request"), (wrong & F.col("act_tool").isNull(), "null_instead_of_tool"), (wrong, "wrong_tool"),
            (~F.col("schema_valid"), "schema_invalid"), (~F.col("arguments_exact"), "argument_mismatch"), (~F.col("status_correct"), "null_status_mismatch"), (~F.col("confirmation_correct"), "confirmation_mismatch"),
        ]
        return first_match(cases, "unknown_e2e_failure")
    cases = [(wrong, "tool_wrong"), (~F.col("schema_valid"), "schema_fail"), (~F.col("arguments_exact"), "argument_exact_fail"), (~F.col("status_correct"), "status_fail"), (~F.col("confirmation_correct"), "confirmation_fail")]
    return first_match(cases, "other")


def class_report(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted means; 0 for 0 / 0.

    One pass counts pairs; what follows is on the small table of classes.
    """
    pairs = rows.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("e").alias("label"), F.col("n").alias("support"), F.lit(0).alias("named"), F.when(F.col("e").eqNullSafe(F.col("p")), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("named"), F.lit(0).cast("bigint").alias("hit")))).alias("s")).select("s.*")
    by = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "named", "hit")])
    by = by.withColumns({"precision": ratio(F.col("hit"), F.col("named"), 0.0), "recall": ratio(F.col("hit"), F.col("support"), 0.0)})
    by = by.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    columns = ("precision", "recall", "f1")
    each = by.select(F.coalesce(F.col("label").cast("string"), F.lit("None")).alias("label"), *columns, "support")
    macro = by.agg(*[F.avg(c).alias(c) for c in columns], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *columns, "support")
    weighted = by.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in columns], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *columns, "support")
    return each.unionByName(macro).unionByName(weighted)


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """The 2 x 2 table of two runs on the same rows, exact p and z."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    table = rows.agg(*[F.count_if(c).cast("bigint").alias(n) for c, n in ((a & b, "both"), (a & ~b, "only_a"), (~a & b, "only_b"), (~a & ~b, "neither"))])
    return table.withColumn("p_exact", mcnemar_exact(F.col("only_a"), F.col("only_b"))).withColumn("z", mcnemar_z(F.col("only_a"), F.col("only_b")))


def transitions(before: Column, after: Column) -> Column:
    """Fixed, regressed, persistent or stable."""
    return F.when(~before & after, "fixed").when(before & ~after, "regressed").when(~before & ~after, "persistent").otherwise("stable")


def gate(rows: DataFrame, flag: Column, baselines: Mapping[str, float]) -> DataFrame:
    """The rate against fixed baselines: (baseline, base_rate, rate, delta, passed)."""
    table = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in baselines.items()], "baseline string, base_rate double")
    rate = rows.agg(F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias("rate"))
    return F.broadcast(table).crossJoin(F.broadcast(rate)).withColumn("delta", F.col("rate") - F.col("base_rate")).withColumn("passed", F.col("delta") >= 0)


def argument_diff(expected: Column, actual: Column) -> Column:
    """Of two map<string, string>: struct of the sorted keys missing, extra and changed."""
    missing = F.array_sort(F.array_except(F.map_keys(expected), F.map_keys(actual)))
    extra = F.array_sort(F.array_except(F.map_keys(actual), F.map_keys(expected)))
    shared = F.array_intersect(F.map_keys(expected), F.map_keys(actual))
    changed = F.array_sort(F.filter(shared, lambda k: ~F.element_at(expected, k).eqNullSafe(F.element_at(actual, k))))
    return F.struct(missing.alias("missing"), extra.alias("extra"), changed.alias("changed"))


def diff_note(diff: Column) -> Column:
    part = lambda n: F.when(F.size(diff[n]) > 0, F.concat(F.lit(f"{n}="), F.array_join(diff[n], ",")))
    return F.coalesce(F.nullif(F.concat_ws("; ", part("missing"), part("extra"), part("changed")), F.lit("")), F.lit("argument mismatch"))


def top_counts(values: DataFrame, value: str, n: int, seen: str | None = None) -> DataFrame:
    """The n most frequent values; ties by their smallest ``seen``, or without it in the order of the values."""
    if seen:
        return values.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seen).alias("first_seen")).orderBy(F.col("n").desc(), "first_seen").limit(n)
    return values.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), value).limit(n)


def summarize(rows: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation (0 for one row), min and max of what isn't null."""
    v = rows.withColumn("__v", value.cast("double")).filter("__v is not null")
    return v.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.avg("__v").alias("mean"), F.coalesce(F.stddev_samp("__v"), F.lit(0.0)).alias("stdev"), F.min("__v").alias("min"), F.max("__v").alias("max"))


def all_true(*flags: Column) -> Column:
    """All flags, null as false."""
    out = F.lit(True)
    for f in flags:
        out = out & F.coalesce(f, F.lit(False))
    return out


def is_unique(rows: DataFrame, key: str) -> DataFrame:
    """(n, n_distinct, is_unique)."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_distinct")).withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def coverage(rows: DataFrame, key: str, catalog: DataFrame, name: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    have, want = rows.select(F.col(key).alias("key")).distinct(), catalog.select(F.col(name).alias("key")).distinct()
    return have.join(want, "key", "left_anti").withColumn("side", F.lit("unexpected")).unionByName(want.join(have, "key", "left_anti").withColumn("side", F.lit("missing")))


def missing_and_extra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks, and the reverse: (key, side)."""
    x, y = a.select(F.col(key).alias("key")).distinct(), b.select(F.col(key).alias("key")).distinct()
    return x.join(y, "key", "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, "key", "left_anti").withColumn("side", F.lit("extra")))


def proportions(rows: DataFrame, flag: Column, by: Sequence[str]) -> DataFrame:
    """N, successes, rate and Wilson bounds per group."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(flag, F.lit(False))).cast("bigint").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"rate": F.col("k") / F.col("n"), "low": low, "high": high})


def running_number(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "number") -> DataFrame:
    """W8, T23."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
