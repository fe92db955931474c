"""Queries of the scorer: every event is an example of a tool call, and of a prediction that goes wrong in its own way.

The calls' JSON texts are built by expressions that mean the same to both
engines; the SQL twins then score the JSON by rules of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.validate import CATALOG_SCHEMA
from tessera.plans._tables import table

#: name, confirmation, and of each argument: name, type, required, minimum, maximum.
TOOLS = {
    "view": (False, [("k", "integer", True, 0, 80), ("note", "string", True, None, None), ("ratio", "number", False, None, None)]),
    "signup": (False, [("name", "string", True, None, None), ("contact_phone", "string", True, None, None), ("flag", "boolean", False, None, None)]),
    "purchase": (True, [("k", "integer", True, None, None), ("days", "array", False, None, None), ("who", "object", True, None, None)]),
    "click": (False, [("note", "string", True, None, None), ("flag", "boolean", True, None, None)]),
}

_K, _U = "CAST(event_id % 97 AS STRING)", "CAST(user_id % 1000 AS STRING)"
_OF = "CASE event_type WHEN 'view' THEN {view} WHEN 'signup' THEN {signup} WHEN 'purchase' THEN {purchase} ELSE {click} END"
#: Arguments as they should be, as they may be written as well, and wrong ones.
_GOLD = _OF.format(
    view=f"""'"k":' || {_K} || ',"note":"Café số ' || {_U} || '"'""",
    signup=f"""'"name":"Anh_Minh' || {_U} || '","contact_phone":"+84 90-' || {_U} || '","flag":' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END""",
    purchase=f"""'"k":' || {_K} || ',"days":["Mon","tue",' || {_K} || '],"who":{{"id":' || {_U} || ',"tag":"Đà Nẵng","more":{{"x":[1,2]}}}}'""",
    click=f"""'"note":"open ' || {_U} || '","flag":true'""",
)
_ALIKE = _OF.format(
    view=f"""'"note":"  cafe  SO ' || {_U} || ' ","k":' || {_K}""",
    signup=f"""'"contact_phone":"(84) 90 ' || {_U} || '","name":"minh' || {_U} || '","flag":' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END""",
    purchase=f"""'"k":' || {_K} || ',"days":[' || {_K} || ',"TUE","mon"],"who":{{"more":{{"x":[2,1],"y":0}},"id":' || {_U} || ',"tag":"da nang","other":null}}'""",
    click=f"""'"flag":1,"note":"OPEN ' || {_U} || '"'""",
)
_WRONG = _OF.format(
    view=f"""'"k":"' || {_K} || '","note":"cafe"'""",
    signup=f"""'"name":"Lan","contact_phone":"' || {_U} || '","flag":null'""",
    purchase=f"""'"k":' || {_K} || ',"days":["mon"],"who":{{"id":-1,"tag":"x"}}'""",
    click="""'"note":"","flag":false'""",
)
_NEEDS = "CASE WHEN event_type = 'purchase' THEN 'true' ELSE 'false' END"
_EXPECTED = f"""CASE WHEN event_type = 'error' THEN '{{"tool":null,"status":"' || CASE WHEN event_id % 2 = 0 THEN 'unsupported' ELSE 'clarification' END || '","arguments":{{}},"requires_confirmation":false}}'
  ELSE '{{"tool":"' || event_type || '","arguments":{{' || {_GOLD} || '}},"requires_confirmation":' || {_NEEDS} || '}}' END"""
_WAY = "(event_id + user_id) % 14"


def _call(tool: str, arguments: str, confirmation: str = _NEEDS, status: str = "''") -> str:
    return f"""'{{"tool":' || {tool} || {status} || ',"arguments":' || {arguments} || ',"requires_confirmation":' || {confirmation} || '}}'"""


def _object(members: str) -> str:
    return "'{' || CASE WHEN event_type = 'error' THEN '' ELSE " + members + " END || '}'"


_SAME = "CASE WHEN event_type = 'error' THEN 'null' ELSE '\"' || event_type || '\"' END"
_SAID = "CASE WHEN event_type = 'error' THEN ',\"status\":\"unsupported\"' ELSE '' END"
_PREDICTED = f"""CASE {_WAY}
  WHEN 0 THEN {_EXPECTED} WHEN 1 THEN {_call(_SAME, _object(_ALIKE), status=_SAID)} WHEN 2 THEN {_call(_SAME, _object(_WRONG), status=_SAID)}
  WHEN 3 THEN {_call(_SAME, _object(_GOLD + """ || ',"extra":1'"""), status=_SAID)} WHEN 4 THEN {_call(_SAME, "'{}'", status=_SAID)} WHEN 5 THEN {_call("'\"view\"'", "'{" + '"k":5,"note":"n","ratio":2.5' + "}'", "'false'")}
  WHEN 6 THEN {_call("'null'", "'{}'", "'false'", "',\"status\":\"unsupported\"'")} WHEN 7 THEN {_call(_SAME, _object(_GOLD), "CASE WHEN event_type = 'purchase' THEN 'false' ELSE 'true' END", _SAID)}
  WHEN 9 THEN {_call(_SAME, "'[1]'", status=_SAID)} WHEN 10 THEN {_call("'\"fly\"'", "'{}'", status="',\"status\":\"unsupported\"'")} WHEN 11 THEN {_call("'null'", "'{}'", "'false'", "',\"status\":\"odd\"'")}
  WHEN 12 THEN '"no call"' WHEN 13 THEN {_call(_SAME, _object(_GOLD), "'null'", _SAID)} END"""
#: Way 8 has no prediction; ids divisible by 3 have an earlier one that a later line replaces.


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c, [(a, t, r, None, low, high, None) for a, t, r, low, high in args]) for n, (c, args) in TOOLS.items()], CATALOG_SCHEMA)


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'g' || CAST(user_id % 3 AS STRING) END"
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("line_no"), F.expr(group).alias("group"), F.parse_json(F.expr(_EXPECTED)).alias("expected"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(f"{_WAY} != 8")
    last = rows.select(F.col("event_id").alias("id"), F.lit(2).alias("line_no"), F.parse_json(F.expr(_PREDICTED)).alias("prediction"))
    first = rows.filter("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.lit(1).alias("line_no"), F.parse_json(F.lit('{"tool":"view","arguments":{}}')).alias("prediction"))
    return first.unionByName(last)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_examples(_examples(spark, sf_dir), _predictions(spark, sf_dir), _catalog(spark))


FLAGS = ("tool_correct", "arguments_exact", "schema_valid", "status_correct", "confirmation_correct", "end_to_end")


def score_examples(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "group", "args_correct", "args_total", *FLAGS)


def score_report(spark, sf_dir):
    out = M.report(_scored(spark, sf_dir))
    return out.select(F.coalesce("group", F.lit("all")).alias("group"), "count", *[F.round(c, 6).alias(c) for c in ("tool_selection_accuracy", "schema_valid_rate", "end_to_end_task_success", "soft_argument_accuracy")], "end_to_end_ci_95")


def score_errors(spark, sf_dir):
    failed = _scored(spark, sf_dir).filter("not end_to_end")
    return failed.groupBy(M.error_type().alias("error"), M.error_type(detailed=False).alias("short_error")).agg(F.count(F.lit(1)).alias("n"))


def score_fields(spark, sf_dir):
    return M.field_accuracy(_scored(spark, sf_dir)).select("field", "correct", "total", F.round("accuracy", 6).alias("accuracy"))


def score_negatives(spark, sf_dir):
    out = M.negative_accuracy(_scored(spark, sf_dir))
    return out.select("n_null", *[F.round(c, 6).alias(c) for c in ("null_status_accuracy", "status_only_accuracy", "confirmation_accuracy")])


def score_variants(spark, sf_dir):
    """Successes by each definition; the soft accuracy of the second family; the rates over predictions."""
    rows = _scored(spark, sf_dir)
    flags = M.end_to_end_variants()
    out = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()], F.round(F.avg(M.soft_containment()), 6).alias("soft_containment"))
    over = M.success_of_predictions(_examples(spark, sf_dir).filter("id % 13 != 0"), _predictions(spark, sf_dir), _catalog(spark))
    over = over.select(F.col("count").alias("n_predictions"), *[F.round(c, 6).alias(f"cs_fix_{c}") for c in ("tool_acc", "e2e")])
    return F.broadcast(out).crossJoin(over)


def score_buckets(spark, sf_dir):
    """Per tool and per group in one pass; classes without a tool last."""
    from pyspark.sql import Window

    from tessera.functions.text import label_class

    rows = _scored(spark, sf_dir).withColumn("tool", label_class(F.col("exp_tool"), F.col("exp_status")))
    out = M.rates(rows, ["tool_correct", "end_to_end"], ["tool", "group"], [["tool"], ["group"]])
    place = F.row_number().over(Window.partitionBy(F.col("tool").isNull()).orderBy(*M.class_order(F.col("tool")), "group")).cast("bigint")
    return out.select("tool", "group", place.alias("place"), "count", *[F.round(f"{c}_rate", 6).alias(c) for c in ("tool_correct", "end_to_end")])


def most_common_first_seen(spark, sf_dir):
    return M.top_counts(table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 40), "bucket", 15, "event_id").select("bucket", "n", "first_seen")


_PILOT_FLAGS = {
    "tool_correct": "event_id % 3 != 0", "arguments_correct": "event_id % 5 != 0", "status_correct": "event_id % 4 != 0", "confirmation_correct": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE true END",
    "launch_success": "event_id % 7 != 0", "semantic_success": "event_id % 2 = 0", "execute_disabled": "event_id % 6 != 0", "no_external_launch": "event_id % 8 != 0",
}


def pilot_summary(spark, sf_dir):
    """Tasks are the events with an id below 90 % of the largest number of users; records of other ids are dropped."""
    events = table(spark, sf_dir, "events")
    tasks = events.filter("event_id % 10 != 9").select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("supported"))
    records = events.filter("event_id % 10 != 3").select(F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("supported"), *[F.expr(e).alias(n) for n, e in _PILOT_FLAGS.items()])
    out = M.pilot_summary(tasks, records.withColumn("full_execution_success", M.pilot_success()).drop("supported"))
    return out.select(*[c if k != "double" else F.round(c, 6).alias(c) for c, k in out.dtypes])


QUERIES = {f.__name__: f for f in (score_examples, score_report, score_errors, score_fields, score_negatives, score_variants, score_buckets, most_common_first_seen, pilot_summary)}

_FOLD = "lower(strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D')))"


def _norm(c: str) -> str:
    return rf"regexp_replace(regexp_replace({_FOLD.format(c=c)}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"


def _text(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN 'None' WHEN json_type({v}) = 'BOOLEAN' THEN CASE WHEN {v}::VARCHAR = 'true' THEN 'True' ELSE 'False' END WHEN json_type({v}) = 'VARCHAR' THEN {v}->>'$' ELSE {v}::VARCHAR END)"


def _num(v: str) -> str:
    return f"(CASE json_type({v}) WHEN 'BOOLEAN' THEN CASE WHEN {v}::VARCHAR = 'true' THEN 1 ELSE 0 END WHEN 'VARCHAR' THEN NULL WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'NULL' THEN NULL ELSE try_cast({v}::VARCHAR AS DOUBLE) END)"


def _is(v: str, *kinds: str) -> str:
    return f"coalesce(json_type({v}) IN ({', '.join(map(repr, kinds))}), false)"


def _match(name: str, e: str, a: str, depth: int) -> str:
    """The comparison of one argument, written out to some levels of objects."""
    items = lambda v: f"list_sort(list_transform(CAST({v} AS JSON[]), lambda i{depth}: {_norm(_text(f'i{depth}'))}))"
    key = f"k{depth}"
    inner = "false" if not depth else f"(len(list_filter(json_keys({e}), lambda {key}: NOT (coalesce(list_contains(json_keys({a}), {key}), false) AND {_match(key, f'json_extract({e}, {key})', f'json_extract({a}, {key})', depth - 1)})) ) = 0)"
    bare = rf"regexp_replace({_norm('{v}')}, '^(anh|chị|chi|em|cô|co|chú|chu|bác|bac|ông|ong|bà|ba|thầy|thay)\s+(\S)', '\2')"
    named = lambda v: bare.replace("{v}", f"replace({_text(v)}, '_', ' ')")
    digits = lambda v: f"regexp_replace({_text(v)}, '[^0-9]', '', 'g')"
    return f"""coalesce(CASE WHEN {_is(e, 'OBJECT')} THEN {_is(a, 'OBJECT')} AND {inner} WHEN {_is(e, 'ARRAY')} THEN CASE WHEN {_is(a, 'ARRAY')} THEN {items(e)} = {items(a)} ELSE false END
      WHEN {_is(e, 'BOOLEAN', 'UBIGINT', 'BIGINT')} THEN {_num(e)} = {_num(a)} WHEN contains(lower({name}), 'phone') THEN {digits(e)} = {digits(a)}
      WHEN lower({name}) = 'name' THEN {named(e)} = {named(a)} ELSE {_norm(_text(e))} = {_norm(_text(a))} END, false)"""


def _spec() -> str:
    null = lambda v: "NULL" if v is None else str(v)
    rows = [f"('{n}', {str(c).lower()}, '{a}', '{t}', {str(r).lower()}, {null(low)}::BIGINT, {null(high)}::BIGINT)" for n, (c, args) in TOOLS.items() for a, t, r, low, high in args]
    return f"spec(tool, confirmation, arg, kind, required, low, high) AS (VALUES {', '.join(rows)})"


_CTE = f"""{_spec()}, tools AS (SELECT tool, any_value(confirmation) AS confirmation, list(arg) AS known FROM spec GROUP BY tool),
  raw AS (SELECT event_id AS id, event_type, user_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'g' || CAST(user_id % 3 AS STRING) END AS "group", ({_EXPECTED})::JSON AS x, coalesce(({_PREDICTED})::JSON, '{{}}'::JSON) AS p FROM events),
  c AS (SELECT *, json_extract(x, '$.arguments') AS xa, CASE WHEN json_type(json_extract(p, '$.arguments')) = 'OBJECT' THEN json_extract(p, '$.arguments') ELSE '{{}}'::JSON END AS pa, x->>'$.tool' AS x_tool, p->>'$.tool' AS p_tool, x->>'$.status' AS x_status, p->>'$.status' AS p_status,
    x->>'$.requires_confirmation' AS x_conf, CASE WHEN json_type(json_extract(p, '$.requires_confirmation')) = 'BOOLEAN' THEN p->>'$.requires_confirmation' END AS p_conf FROM raw),
  args AS (SELECT id, k, json_extract(xa, k) AS e, json_extract(pa, k) AS a, list_contains(json_keys(pa), k) AS has FROM (SELECT id, xa, pa, unnest(json_keys(xa)) AS k FROM c)),
  hit AS (SELECT id, k, coalesce(has, false) AND {_match('k', 'e', 'a', 3)} AS ok FROM args),
  per AS (SELECT id, count(*) FILTER (ok) AS args_correct, count(*) AS args_total FROM hit GROUP BY id),
  faults AS (SELECT c.id, count(*) FILTER (CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN required
      WHEN kind != CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END THEN true
      WHEN kind = 'integer' THEN coalesce(v::VARCHAR::BIGINT < low, false) OR coalesce(v::VARCHAR::BIGINT > high, false) ELSE false END) AS n FROM (SELECT c.id, s.*, json_extract(c.pa, s.arg) AS v FROM c JOIN spec s ON s.tool = c.p_tool) c GROUP BY c.id),
  s AS (SELECT c.*, coalesce(args_correct, 0)::INT AS args_correct, coalesce(args_total, 0)::INT AS args_total, x_tool IS NOT DISTINCT FROM p_tool AS tool_correct,
    coalesce(args_correct, 0) = coalesce(args_total, 0) AND list_sort(json_keys(xa)) = list_sort(json_keys(pa)) AS arguments_exact,
    CASE WHEN p_tool IS NULL THEN coalesce(p_status IN ('clarification', 'unsupported', 'rejected'), false) WHEN t.tool IS NULL THEN false WHEN coalesce(json_type(json_extract(p, '$.arguments')), '') != 'OBJECT' THEN false
      ELSE len(list_filter(json_keys(pa), lambda q: NOT list_contains(t.known, q))) = 0 AND faults.n = 0 AND p_conf IS NOT DISTINCT FROM t.confirmation::VARCHAR END AS schema_valid,
    x_tool IS NOT NULL OR (p_tool IS NULL AND x_status IS NOT DISTINCT FROM p_status) AS status_correct, x_conf IS NOT DISTINCT FROM p_conf AS confirmation_correct
    FROM c LEFT JOIN per USING (id) LEFT JOIN tools t ON t.tool = c.p_tool LEFT JOIN faults USING (id)),
  f AS (SELECT *, tool_correct AND arguments_exact AND schema_valid AND status_correct AND confirmation_correct AS end_to_end FROM s)"""

_LENIENT = f"(CASE WHEN {_is('e', 'VARCHAR')} AND {_is('a', 'VARCHAR')} THEN lower(e->>'$') = lower(a->>'$') WHEN {_num('e')} IS NOT NULL AND {_num('a')} IS NOT NULL THEN {_num('e')} = {_num('a')} ELSE coalesce(e::VARCHAR = a::VARCHAR, false) END)"
_RATES = "round(avg(tool_correct::INT), 6) AS tool_selection_accuracy, round(avg(schema_valid::INT), 6) AS schema_valid_rate, round(avg(end_to_end::INT), 6) AS end_to_end_task_success, round(coalesce(sum(args_correct) / nullif(sum(args_total), 0)::DOUBLE, 1), 6) AS soft_argument_accuracy"
_P, _N = "avg(end_to_end::INT)", "count(*)"
_BOUND = "format('{{:.3f}}', {side}(({p} + 3.8416 / (2 * {n}) {sign} 1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n})) / (1 + 3.8416 / {n}), {end}::DOUBLE))"
_CI = f"'[' || {_BOUND.format(side='greatest', p=_P, n=_N, sign='-', end=0)} || ', ' || {_BOUND.format(side='least', p=_P, n=_N, sign='+', end=1)} || ']'"
_PILOT_LOW = "greatest(0::DOUBLE, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt((k / n * (1 - k / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))"

ORACLE = {
    "score_examples": f'WITH {_CTE} SELECT id, "group", args_correct, args_total, {", ".join(FLAGS)} FROM f',
    "score_report": f"WITH {_CTE} SELECT 'all' AS \"group\", count(*) AS count, {_RATES}, {_CI} AS end_to_end_ci_95 FROM f UNION ALL SELECT \"group\", count(*), {_RATES}, {_CI} FROM f GROUP BY \"group\"",
    "score_errors": f"""WITH {_CTE} SELECT CASE WHEN NOT tool_correct AND x_tool IS NULL THEN 'unsafe_or_unwanted_tool_for_null_request' WHEN NOT tool_correct AND p_tool IS NULL THEN 'null_instead_of_tool' WHEN NOT tool_correct THEN 'wrong_tool' WHEN NOT schema_valid THEN 'schema_invalid'
      WHEN NOT arguments_exact THEN 'argument_mismatch' WHEN NOT status_correct THEN 'null_status_mismatch' WHEN NOT confirmation_correct THEN 'confirmation_mismatch' ELSE 'unknown_e2e_failure' END AS error,
      CASE WHEN NOT tool_correct THEN 'tool_wrong' WHEN NOT schema_valid THEN 'schema_fail' WHEN NOT arguments_exact THEN 'argument_exact_fail' WHEN NOT status_correct THEN 'status_fail' WHEN NOT confirmation_correct THEN 'confirmation_fail' ELSE 'other' END AS short_error, count(*) AS n FROM f WHERE NOT end_to_end GROUP BY ALL""",
    "score_fields": f"WITH {_CTE} SELECT k AS field, count(*) FILTER (ok) AS correct, count(*) AS total, round(avg(ok::INT), 6) AS accuracy FROM hit GROUP BY k",
    "score_negatives": f"WITH {_CTE} SELECT count(*) FILTER (x_tool IS NULL) AS n_null, round(avg(status_correct::INT) FILTER (x_tool IS NULL), 6) AS null_status_accuracy, round(avg((x_status IS NOT DISTINCT FROM p_status)::INT) FILTER (x_tool IS NULL), 6) AS status_only_accuracy, round(avg(confirmation_correct::INT), 6) AS confirmation_accuracy FROM f",
    "score_variants": f"""WITH {_CTE}, need AS (SELECT f.id, count(*) FILTER (required) AS n_required, count(*) FILTER (required AND {_text('v')} NOT IN ('None', '')) AS n_filled,
        count(*) FILTER (required AND v IS NOT NULL AND w IS NOT NULL AND trim({_text('v')}) != '' AND trim({_text('w')}) != '' AND (contains(lower(trim({_text('w')})), lower(trim({_text('v')}))) OR contains(lower(trim({_text('v')})), lower(trim({_text('w')}))))) AS n_soft
        FROM (SELECT f.id, spec.*, json_extract(pa, arg) AS v, json_extract(xa, arg) AS w FROM f JOIN spec ON spec.tool = f.x_tool) f GROUP BY f.id),
      len AS (SELECT id, bool_and({_LENIENT}) AS given FROM args GROUP BY id),
      g AS (SELECT f.*, coalesce(n_required, 0) AS n_required, coalesce(n_filled, 0) AS n_filled, n_soft, coalesce(given, true) AS given FROM f LEFT JOIN need USING (id) LEFT JOIN len USING (id)),
      again AS (SELECT g.*, w.n AS copies, id % 13 != 0 AS known FROM g, LATERAL (SELECT CASE WHEN (id + user_id) % 14 = 8 THEN 0 ELSE 1 END AS n) w)
      SELECT count(*) FILTER (end_to_end) AS canonical, count(*) FILTER (tool_correct AND args_correct = args_total AND len(list_filter(json_keys(xa), lambda q: NOT list_contains(json_keys(pa), q))) = 0 AND (x_tool IS NOT NULL OR p_tool IS NULL OR x_status IS NOT DISTINCT FROM p_status) AND confirmation_correct AND schema_valid) AS custom,
      count(*) FILTER (tool_correct AND (x_tool IS NULL OR n_filled = n_required)) AS required_filled, count(*) FILTER (tool_correct AND CASE WHEN x_tool IS NULL THEN x_status IS NOT DISTINCT FROM p_status ELSE given AND confirmation_correct END) AS lenient_confirmed,
      count(*) FILTER (tool_correct AND given AND (coalesce(x_status, '') = '' OR x_status IS NOT DISTINCT FROM p_status)) AS lenient_status,
      round(avg(CASE WHEN NOT tool_correct THEN 0 WHEN x_tool IS NULL OR n_required = 0 THEN 1 ELSE n_soft / n_required::DOUBLE END), 6) AS soft_containment,
      (sum(copies) + count(*) FILTER (copies = 1 AND id % 3 = 0))::BIGINT AS n_predictions,
      round((count(*) FILTER (known AND copies = 1 AND tool_correct) + count(*) FILTER (known AND copies = 1 AND id % 3 = 0 AND x_tool = 'view')) / (sum(copies) + count(*) FILTER (copies = 1 AND id % 3 = 0))::DOUBLE, 6) AS cs_fix_tool_acc,
      round(count(*) FILTER (known AND copies = 1 AND tool_correct AND (x_tool IS NULL OR n_filled = n_required)) / (sum(copies) + count(*) FILTER (copies = 1 AND id % 3 = 0))::DOUBLE, 6) AS cs_fix_e2e FROM again""",
    "score_buckets": f"""WITH {_CTE}, b AS (SELECT coalesce(x_tool, 'NULL:' || coalesce(x_status, 'None')) AS tool, "group", tool_correct AS t, end_to_end AS e FROM f), r AS (SELECT tool, "group", count(*) AS count, round(avg(t::INT), 6) AS tool_correct, round(avg(e::INT), 6) AS end_to_end FROM b GROUP BY GROUPING SETS ((tool), ("group")))
      SELECT tool, "group", row_number() OVER (PARTITION BY tool IS NULL ORDER BY starts_with(tool, 'NULL:'), tool, "group") AS place, count, tool_correct, end_to_end FROM r""",
    "most_common_first_seen": "SELECT user_id % 40 AS bucket, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 15",
    "pilot_summary": f"""WITH r AS (SELECT event_id, event_type != 'error' AS supported, {", ".join(f"coalesce({e}, false) AS {n}" for n, e in _PILOT_FLAGS.items())} FROM events WHERE event_id % 10 NOT IN (3, 9)),
      g AS (SELECT *, CASE WHEN supported THEN tool_correct AND arguments_correct AND confirmation_correct AND launch_success AND semantic_success ELSE tool_correct AND status_correct AND execute_disabled AND no_external_launch END AS full_ok, tool_correct AND CASE WHEN supported THEN arguments_correct ELSE status_correct END AS said,
        NOT supported AND execute_disabled AND no_external_launch AND tool_correct AND status_correct AS safe FROM r),
      t AS (SELECT count(*) AS n, count(*) FILTER (full_ok)::DOUBLE AS k, count(*) FILTER (said) AS p, count(*) FILTER (supported) AS s, count(*) FILTER (supported AND launch_success) AS l, count(*) FILTER (supported AND semantic_success) AS m, count(*) FILTER (NOT supported) AS g, count(*) FILTER (safe) AS f FROM g),
      q AS (SELECT count(*) AS planned FROM events WHERE event_id % 10 != 9)
      SELECT planned AS planned_tasks, n AS completed_tasks, k::BIGINT AS full_execution_successes, round(k / n, 6) AS execution_accuracy, round({_PILOT_LOW}, 6) AS low, round({_PILOT_LOW.replace("greatest(0::DOUBLE", "least(1::DOUBLE").replace("- 1.96", "+ 1.96")}, 6) AS high, p AS prediction_successes, round(p / n::DOUBLE, 6) AS prediction_accuracy,
      s AS supported_tasks, round(l / s::DOUBLE, 6) AS activity_launch_rate, round(m / s::DOUBLE, 6) AS semantic_success_rate, g AS negative_tasks, f AS negative_safety_successes, round(f / g::DOUBLE, 6) AS negative_safety_rate, planned = n AS complete FROM t, q""",
}
