"""Queries on scoring: documents are examples, labels are gold, simple rules are runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stats import normal_p
from tessera.operators import metrics as M
from tessera.plans._tables import table

#: Run A says good if a text is longer than 500 characters, run B if than 1500; gold is quality = 1.
_JOINED = "documents d LEFT JOIN labels l USING (doc_id)"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = F.col("quality") == 1
    return docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left").withColumns({"run_a": F.col("n_chars") > 500, "run_b": F.col("n_chars") > 1500}).withColumns({"ok_a": F.coalesce(F.col("run_a") == gold, F.lit(False)), "ok_b": F.coalesce(F.col("run_b") == gold, F.lit(False))})


_E = f"""e AS (SELECT doc_id, lang, source, n_chars, quality, toxic, n_chars > 500 AS run_a, n_chars > 1500 AS run_b,
  coalesce((n_chars > 500) = (quality = 1), false) AS ok_a, coalesce((n_chars > 1500) = (quality = 1), false) AS ok_b FROM {_JOINED})"""
_LOW = "greatest(0, (k::DOUBLE / n + 3.8416 / (2 * n) - 1.96 * sqrt((k::DOUBLE / n * (1 - k::DOUBLE / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))"
_HIGH = "least(1, (k::DOUBLE / n + 3.8416 / (2 * n) + 1.96 * sqrt((k::DOUBLE / n * (1 - k::DOUBLE / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))"


def eval_left_join_rates(spark, sf_dir):
    out = M.rates(_examples(spark, sf_dir), ["ok_a", "ok_b"], ["lang"])
    return out.select("lang", "count", F.round("ok_a_rate", 6).alias("rate_a"), F.round("ok_b_rate", 6).alias("rate_b"))


def eval_wilson(spark, sf_dir):
    out = M.proportions(_examples(spark, sf_dir), F.col("ok_a"), ["lang"])
    return out.select("lang", "n", "k", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


def eval_grouping_sets(spark, sf_dir):
    out = M.rates(_examples(spark, sf_dir), ["ok_a"], ["lang", "source"], [["lang"], ["source"]])
    return out.select("lang", "source", "count", F.round("ok_a_rate", 6).alias("rate"))


def eval_rollup_overall(spark, sf_dir):
    out = M.rates(_examples(spark, sf_dir), ["ok_a"], ["lang"], [["lang"], []])
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "count", F.round("ok_a_rate", 6).alias("rate"))


def eval_confusion(spark, sf_dir):
    e = _examples(spark, sf_dir)
    return M.confusion(e, [F.col("quality"), F.col("toxic")], [F.col("run_a").cast("int")])


def eval_error_taxonomy(spark, sf_dir):
    kind = M.first_match([(F.col("quality").isNull(), "no_gold"), (F.col("ok_a"), "correct"), ((F.col("quality") == 0) & (F.col("toxic") == 1), "unwanted_toxic"), (F.col("quality") == 0, "unwanted"), (F.col("run_b"), "missed_long")], "missed")
    return _examples(spark, sf_dir).groupBy(kind.alias("error_type")).agg(F.count(F.lit(1)).alias("n"))


def eval_field_accuracy(spark, sf_dir):
    e = _examples(spark, sf_dir).filter("quality is not null")
    fields = F.array(F.struct(F.lit("quality").alias("field"), F.col("quality").alias("gold"), F.col("run_a").cast("int").alias("guess")), F.struct(F.lit("toxic").alias("field"), F.col("toxic").alias("gold"), F.col("run_b").cast("int").alias("guess")))
    each = e.select(F.explode(fields).alias("x")).select("x.*")
    return each.groupBy("field").agg(F.sum((F.col("gold") == F.col("guess")).cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg((F.col("gold") == F.col("guess")).cast("int")), 6).alias("accuracy"))


def eval_class_f1(spark, sf_dir):
    e = _examples(spark, sf_dir).filter("quality is not null").withColumn("guess", F.col("run_a").cast("int"))
    out = M.class_report(e, "quality", "guess")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def eval_soft_accuracy(spark, sf_dir):
    e = _examples(spark, sf_dir).withColumns({"total": F.when(F.col("quality").isNull(), 0).otherwise(2), "hit": F.coalesce((F.col("quality") == F.col("run_a").cast("int")).cast("int") + (F.col("toxic") == F.col("run_b").cast("int")).cast("int"), F.lit(0))})
    from tessera.functions.stats import ratio

    return e.groupBy("source").agg(F.round(ratio(F.sum("hit"), F.sum("total"), 1.0), 6).alias("soft"), F.sum("total").alias("total"))


def eval_null_status(spark, sf_dir):
    e = _examples(spark, sf_dir)
    null_gold = F.col("quality").isNull()
    return e.groupBy("lang").agg(F.count_if(null_gold).cast("bigint").alias("n_null"), F.round(F.coalesce(F.avg(F.when(null_gold, (~F.col("run_a")).cast("int"))), F.lit(1.0)), 6).alias("null_accuracy"), F.round(F.avg(F.when(~null_gold, F.col("ok_a").cast("int"))), 6).alias("positive_accuracy"))


def mcnemar_counts(spark, sf_dir):
    return M.agreement(_examples(spark, sf_dir).filter("quality is not null"), F.col("ok_a"), F.col("ok_b")).select("both", "only_a", "only_b", "neither")


def mcnemar_exact(spark, sf_dir):
    out = M.agreement(_examples(spark, sf_dir).filter("quality is not null"), F.col("ok_a"), F.col("toxic") == 0)
    return out.select("only_a", "only_b", F.round("p_exact", 6).alias("p_exact"), F.round("z", 6).alias("z"))


def mcnemar_normal(spark, sf_dir):
    out = M.agreement(_examples(spark, sf_dir).filter("quality is not null"), F.col("ok_a"), F.col("toxic") == 0)
    return out.select(F.round(normal_p(F.col("z")), 6).alias("p_normal"))


def eval_wilson_array(spark, sf_dir):
    """A10; a class of no examples has the interval [0, 0]."""
    from tessera.functions.stats import wilson_array

    e = _examples(spark, sf_dir).withColumn("asked", F.col("lang") != "en")
    out = e.groupBy("lang").agg(F.count_if("asked").alias("n"), F.count_if(F.col("asked") & F.col("ok_a")).alias("k"))
    interval = wilson_array(F.col("k"), F.col("n"))
    return out.select("lang", F.round(interval[0], 6).alias("low"), F.round(interval[1], 6).alias("high"))


def regression_sets(spark, sf_dir):
    e = _examples(spark, sf_dir).filter("quality is not null")
    return e.select("doc_id", M.transitions(F.col("ok_a"), F.col("ok_b")).alias("change"))


def discordant_ids(spark, sf_dir):
    e = _examples(spark, sf_dir).filter("quality is not null and ok_a != ok_b")
    return e.select("doc_id", F.when(F.col("ok_a"), "only_a").otherwise("only_b").alias("side"))


def decision_gate(spark, sf_dir):
    out = M.gate(_examples(spark, sf_dir).filter("quality is not null"), F.col("ok_a"), {"first": 0.5, "second": 0.75, "third": 0.99})
    return out.select("baseline", "base_rate", *[F.round(c, 6).alias(c) for c in ("rate", "delta")], "passed")


def argument_diff(spark, sf_dir):
    given = F.from_json("props", "map<string,string>")
    wanted = F.create_map(F.lit("k"), F.lit("5"), F.lit("z"), F.lit("1"))
    diff = M.argument_diff(wanted, given)
    return table(spark, sf_dir, "events").select(M.diff_note(diff).alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n"))


def telemetry_summary(spark, sf_dir):
    out = M.summarize(table(spark, sf_dir, "events"), F.when(F.col("value") > 0, F.col("value")), ["event_type"])
    return out.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "stdev", "min", "max")])


def rubric_all_true(spark, sf_dir):
    e = _examples(spark, sf_dir)
    return e.groupBy("lang").agg(F.count_if(M.all_true(F.col("quality") == 1, F.col("toxic") == 0, F.col("run_a"))).cast("bigint").alias("passed"), F.count(F.lit(1)).alias("n"))


def pilot_rates(spark, sf_dir):
    e = _examples(spark, sf_dir)
    from tessera.functions.stats import ratio

    judged = F.count_if(F.col("quality").isNotNull())
    return e.groupBy("source").agg(F.round(ratio(judged, F.count(F.lit(1))), 6).alias("judged"), F.round(ratio(F.count_if(F.col("quality") == 1), judged), 6).alias("good"), F.round(ratio(F.count_if((F.col("quality") == 1) & F.col("ok_a")), F.count_if(F.col("quality") == 1)), 6).alias("good_found"))


def top_n_counter(spark, sf_dir):
    from tessera.functions.text import tokenize

    words = table(spark, sf_dir, "documents").select(F.explode(tokenize(F.col("text"))).alias("word"))
    return M.top_counts(words, "word", 15)


def coverage_check(spark, sf_dir):
    return M.coverage(table(spark, sf_dir, "customer").select("c_nationkey"), "c_nationkey", table(spark, sf_dir, "supplier").withColumn("n", F.col("s_suppkey") % 40), "n").select(F.col("key").cast("bigint").alias("key"), "side")


def missing_extra_ids(spark, sf_dir):
    return M.missing_and_extra(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumn("doc_id", F.when(F.col("quality") == 0, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id"))), "doc_id").select("key", "side")


def uniqueness(spark, sf_dir):
    return M.is_unique(table(spark, sf_dir, "documents"), "text")


def last_row_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("line_no"), "role", F.sha2("text", 256).alias("digest"))
    return M.last_wins(rows).select("id", "line_no", "role", "digest")


QUERIES = {f.__name__: f for f in (eval_left_join_rates, eval_wilson, eval_grouping_sets, eval_rollup_overall, eval_confusion, eval_error_taxonomy, eval_field_accuracy, eval_class_f1, eval_soft_accuracy, eval_null_status, mcnemar_counts, mcnemar_exact, mcnemar_normal, eval_wilson_array, regression_sets, discordant_ids, decision_gate, argument_diff, telemetry_summary, rubric_all_true, pilot_rates, top_n_counter, coverage_check, missing_extra_ids, uniqueness, last_row_wins)}

_PAIRS = "p AS (SELECT quality AS e, run_a::INT AS p FROM e WHERE quality IS NOT NULL), c AS (SELECT DISTINCT e AS label FROM p UNION SELECT DISTINCT p FROM p), s AS (SELECT label, (SELECT count(*) FROM p WHERE e = label) AS support, (SELECT count(*) FROM p WHERE p.p = label) AS named, (SELECT count(*) FROM p WHERE e = label AND p.p = label) AS hit FROM c), r AS (SELECT label, support, coalesce(hit / nullif(named, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall FROM s), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"

ORACLE = {
    "eval_left_join_rates": f"WITH {_E} SELECT lang, count(*) AS count, round(avg(ok_a::INT), 6) AS rate_a, round(avg(ok_b::INT), 6) AS rate_b FROM e GROUP BY lang",
    "eval_wilson": f"WITH {_E}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (ok_a) AS k FROM e GROUP BY lang) SELECT lang, n, k, round(k::DOUBLE / n, 6) AS rate, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM g",
    "eval_grouping_sets": f"WITH {_E} SELECT lang, source, count(*) AS count, round(avg(ok_a::INT), 6) AS rate FROM e GROUP BY GROUPING SETS ((lang), (source))",
    "eval_rollup_overall": f"WITH {_E} SELECT coalesce(lang, 'all') AS lang, count(*) AS count, round(avg(ok_a::INT), 6) AS rate FROM e GROUP BY ROLLUP (lang)",
    "eval_confusion": f"WITH {_E} SELECT coalesce(quality::VARCHAR, 'None') AS expected, coalesce(toxic::VARCHAR, 'None') AS expected1, coalesce(run_a::INT::VARCHAR, 'None') AS predicted, count(*) AS n FROM e GROUP BY ALL",
    "eval_error_taxonomy": f"WITH {_E} SELECT CASE WHEN quality IS NULL THEN 'no_gold' WHEN ok_a THEN 'correct' WHEN quality = 0 AND toxic = 1 THEN 'unwanted_toxic' WHEN quality = 0 THEN 'unwanted' WHEN run_b THEN 'missed_long' ELSE 'missed' END AS error_type, count(*) AS n FROM e GROUP BY 1",
    "eval_field_accuracy": f"WITH {_E}, x AS (SELECT 'quality' AS field, quality = run_a::INT AS ok FROM e WHERE quality IS NOT NULL UNION ALL SELECT 'toxic', toxic = run_b::INT FROM e WHERE quality IS NOT NULL) SELECT field, count(*) FILTER (ok) AS correct, count(*) AS total, round(avg(ok::INT), 6) AS accuracy FROM x GROUP BY field",
    "eval_class_f1": f"WITH {_E}, {_PAIRS} SELECT label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f",
    "eval_soft_accuracy": f"WITH {_E} SELECT source, round(coalesce(sum(coalesce((quality = run_a::INT)::INT + (toxic = run_b::INT)::INT, 0)) / nullif(sum(CASE WHEN quality IS NULL THEN 0 ELSE 2 END), 0)::DOUBLE, 1), 6) AS soft, sum(CASE WHEN quality IS NULL THEN 0 ELSE 2 END)::BIGINT AS total FROM e GROUP BY source",
    "eval_null_status": f"WITH {_E} SELECT lang, count(*) FILTER (quality IS NULL) AS n_null, round(coalesce(avg((NOT run_a)::INT) FILTER (quality IS NULL), 1), 6) AS null_accuracy, round(avg(ok_a::INT) FILTER (quality IS NOT NULL), 6) AS positive_accuracy FROM e GROUP BY lang",
    "mcnemar_counts": f"WITH {_E} SELECT count(*) FILTER (ok_a AND ok_b) AS both, count(*) FILTER (ok_a AND NOT ok_b) AS only_a, count(*) FILTER (NOT ok_a AND ok_b) AS only_b, count(*) FILTER (NOT ok_a AND NOT ok_b) AS neither FROM e WHERE quality IS NOT NULL",
    "mcnemar_exact": f"WITH {_E}, t AS (SELECT count(*) FILTER (ok_a AND toxic != 0) AS b, count(*) FILTER (NOT ok_a AND toxic = 0) AS c FROM e WHERE quality IS NOT NULL), s AS (SELECT b, c, unnest(generate_series(0, least(b, c))) AS i FROM t) SELECT b AS only_a, c AS only_b, round(least(1, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))), 6) AS p_exact, round((b - c) / sqrt(b + c), 6) AS z FROM s GROUP BY b, c",
    "mcnemar_normal": f"WITH {_E}, t AS (SELECT count(*) FILTER (ok_a AND toxic != 0) AS b, count(*) FILTER (NOT ok_a AND toxic = 0) AS c FROM e WHERE quality IS NOT NULL), z AS (SELECT abs(b - c) / sqrt(2.0::DOUBLE * greatest(b + c, 1)) AS x FROM t), s AS (SELECT x, unnest(generate_series(0, 4000)) AS i FROM z) SELECT round(1 - 2 / sqrt(pi()) * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(x * i / 4000, 2))) * any_value(x) / 12000, 6) + 0.0 AS p_normal FROM s",
    "eval_wilson_array": f"WITH {_E}, g AS (SELECT lang, count(*) FILTER (lang != 'en') AS n, count(*) FILTER (lang != 'en' AND ok_a) AS k FROM e GROUP BY lang) SELECT lang, CASE WHEN n = 0 THEN 0 ELSE round({_LOW}, 6) END::DOUBLE AS low, CASE WHEN n = 0 THEN 0 ELSE round({_HIGH}, 6) END::DOUBLE AS high FROM g",
    "regression_sets": f"WITH {_E} SELECT doc_id, CASE WHEN NOT ok_a AND ok_b THEN 'fixed' WHEN ok_a AND NOT ok_b THEN 'regressed' WHEN NOT ok_a AND NOT ok_b THEN 'persistent' ELSE 'stable' END AS change FROM e WHERE quality IS NOT NULL",
    "discordant_ids": f"WITH {_E} SELECT doc_id, CASE WHEN ok_a THEN 'only_a' ELSE 'only_b' END AS side FROM e WHERE quality IS NOT NULL AND ok_a != ok_b",
    "decision_gate": f"WITH {_E}, r AS (SELECT avg(ok_a::INT) AS rate FROM e WHERE quality IS NOT NULL) SELECT baseline, base_rate::DOUBLE AS base_rate, round(rate, 6) AS rate, round(rate - base_rate::DOUBLE, 6) AS delta, rate - base_rate::DOUBLE >= 0 AS passed FROM (VALUES ('first', 0.5), ('second', 0.75), ('third', 0.99)) b(baseline, base_rate), r",
    "argument_diff": "WITH j AS (SELECT json_keys(props) AS ks, props->>'$.k' AS k FROM events), d AS (SELECT list_sort(list_filter(['k', 'z'], lambda x: NOT list_contains(ks, x))) AS m, list_sort(list_filter(ks, lambda x: x NOT IN ('k', 'z'))) AS x, CASE WHEN list_contains(ks, 'k') AND k IS DISTINCT FROM '5' THEN ['k'] ELSE [] END AS c FROM j) SELECT coalesce(nullif(concat_ws('; ', CASE WHEN len(m) > 0 THEN 'missing=' || array_to_string(m, ',') END, CASE WHEN len(x) > 0 THEN 'extra=' || array_to_string(x, ',') END, CASE WHEN len(c) > 0 THEN 'changed=' || array_to_string(c, ',') END), ''), 'argument mismatch') AS note, count(*) AS n FROM d GROUP BY 1",
    "telemetry_summary": "SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events WHERE value > 0 GROUP BY event_type",
    "rubric_all_true": f"WITH {_E} SELECT lang, count(*) FILTER (coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AND run_a) AS passed, count(*) AS n FROM e GROUP BY lang",
    "pilot_rates": f"WITH {_E} SELECT source, round(count(quality) / count(*)::DOUBLE, 6) AS judged, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0)::DOUBLE, 6) AS good, round(count(*) FILTER (quality = 1 AND ok_a) / nullif(count(*) FILTER (quality = 1), 0)::DOUBLE, 6) AS good_found FROM e GROUP BY source",
    "top_n_counter": "WITH w AS (SELECT unnest(regexp_extract_all(lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))), '[a-z0-9_@.+/*:-]+')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 15",
    "coverage_check": "WITH h AS (SELECT DISTINCT c_nationkey::BIGINT AS key FROM customer), w AS (SELECT DISTINCT s_suppkey % 40 AS key FROM supplier) SELECT key, 'unexpected' AS side FROM h WHERE key NOT IN (SELECT key FROM w) UNION ALL SELECT key, 'missing' FROM w WHERE key NOT IN (SELECT key FROM h)",
    "missing_extra_ids": "WITH l AS (SELECT DISTINCT CASE WHEN quality = 0 THEN doc_id + 10000000 ELSE doc_id END AS key FROM labels), d AS (SELECT DISTINCT doc_id AS key FROM documents) SELECT key, 'missing' AS side FROM d WHERE key NOT IN (SELECT key FROM l) UNION ALL SELECT key, 'extra' FROM l WHERE key NOT IN (SELECT key FROM d)",
    "uniqueness": "SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) = count(DISTINCT text) AS is_unique FROM documents",
    "last_row_wins": "SELECT conv_id AS id, turn AS line_no, role, sha256(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
}
