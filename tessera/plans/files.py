"""Queries that write rows to files and read them back, and checks of labelled items, with SQL that never sees a file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import baselines, build, validate
from tessera.operators import retrieve as R
from tessera.operators.layout import shared_dir
from tessera.plans import datasets, retrieval
from tessera.plans._tables import table
from tessera.sources import io


def _folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that goes when the application ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def _get(field: str, kind: str = "string"):
    return F.try_variant_get("row", f"$.{field}", kind)


def jsonl_lines(spark, sf_dir):
    """A line for each event; every 7th has a blank one before it, every 11th is broken, and none is lost."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    good = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), good)).otherwise(good)
    where = _folder(spark, "lines")
    e.select(F.concat(F.when(F.col("event_id") % 7 == 0, "  \n").otherwise(""), line, F.when(F.col("event_id") % 5 == 0, "\r").otherwise(""))).write.text(where)
    rows = io.read_jsonl(spark, where, "permissive")
    return rows.groupBy(_get("event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(_get("event_id", "bigint")).alias("ids"))


def jsonl_marker(spark, sf_dir):
    """One file for each region's nations; those of a region with a broken line are one marker."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.to_json(F.struct(F.col("n_name").alias("id"))).alias("value"))
    where = _folder(spark, "marked")
    bad = n.filter("n_regionkey = 2").select("n_regionkey", F.lit("{broken").alias("value")).limit(1)
    n.unionByName(bad).repartition("n_regionkey").write.partitionBy("n_regionkey").text(where)
    files = io.read_glob(spark, f"{where}/*/part-*")
    return io.read_jsonl(spark, files, "marker").select(_get("id").alias("id"))


def jsonl_numbers(spark, sf_dir):
    """Rows written in order of their keys come back with line numbers that say that order, file by file."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    where = _folder(spark, "numbered")
    io.write_jsonl(c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey"), where)
    rows = io.read_jsonl(spark, where)
    keyed = rows.select("file", "line_no", _get("c_custkey", "bigint").alias("c_custkey"), _get("c_name").alias("c_name"), F.round(_get("c_acctbal", "double"), 2).alias("c_acctbal"), _get("segment").alias("segment"))
    first = keyed.groupBy("file").agg(F.min("c_custkey").alias("first"), F.count_if(F.col("line_no") < 1).alias("odd"))
    return keyed.join(first, "file").select("c_custkey", "c_name", "c_acctbal", "segment", (F.col("line_no") == F.col("c_custkey") - F.col("first") + 1).alias("in_place"))


def imported_rows(spark, sf_dir):
    """Customers that are new, of a file in which some are known, repeated or malformed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_custkey", "c_name")
    line = F.when(F.col("c_custkey") % 13 == 0, "[").otherwise(F.to_json(F.struct("id", "c_name")))
    lines = c.select("c_custkey", line.alias("value"))
    where = _folder(spark, "incoming")
    lines.unionByName(lines.filter("c_custkey % 10 = 1")).select("value").write.text(where)
    new, counts = io.import_rows(c.filter("c_custkey % 4 = 0").select("id"), io.read_jsonl(spark, where, "permissive"))
    return new.agg(F.count(F.lit(1)).alias("added"), F.sum(_get("id", "bigint")).alias("ids")).crossJoin(F.broadcast(counts))


def written_hash(spark, sf_dir):
    """K8: the digest of a written file is that of its rows; the frozen one passes, another one is told."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name")
    where = _folder(spark, "frozen")
    n.coalesce(1).write.text(where)
    return io.content_hash(spark, f"{where}/part-*").select("sha256")


def item_messages(spark, sf_dir):
    """The messages, in their order, of labelled items made of the parts; a line number is the part's key."""
    k = F.col("p_partkey")
    arguments = (
        F.when(k % 6 == 0, F.when(k % 4 != 0, F.concat(F.lit('{"hour":'), (k % 24).cast("string"), F.lit("}"))).otherwise("{}"))
        .when(k % 6 == 1, F.when(k % 4 < 2, F.lit('{"seconds":5}')).otherwise('{"duration_minutes":null}'))
        .when(k % 6 == 2, F.when(k % 4 == 0, F.lit('{"contact":""}')).otherwise('{"contact":"Lan"}'))
        .when(k % 6 == 3, F.lit("{}"))
        .when(k % 6 == 4, F.when(k % 4 == 0, F.lit('{"missing":["hour"]}')).otherwise('{"missing":[]}'))
        .otherwise(F.when(k % 4 == 1, F.lit("[]")).otherwise('{"app_name":"x"}'))
    )
    intents = F.array(*map(F.lit, ("set_alarm", "set_timer", "call_contact", "other", "clarify", "open_app")))
    item = F.concat(
        F.lit('{"id":"i'), (k - F.when(k % 50 == 0, 1).otherwise(0)).cast("string"), F.lit('","utterance":"U '), F.floor(k / 2).cast("string"), F.lit('!","intent":"'), F.get(intents, (k % 6).cast("int")),
        F.lit('","arguments":'), arguments, F.lit(',"risk_level":"low"'), F.when(k % 17 == 0, "").otherwise(',"language":"vi"'), F.when(k % 34 == 0, "").otherwise(F.concat(F.lit(',"split":"'), F.when(k % 3 == 0, "test").otherwise("train"), F.lit('"'))), F.lit("}"),
    )
    found = validate.validate_items(table(spark, sf_dir, "part").select(k.cast("bigint").alias("line_no"), F.parse_json(item).alias("item")))
    return found.groupBy("line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda s: s["message"]), "|").alias("messages"))


def policy_outcomes(spark, sf_dir):
    """Cases made of the parts; each expected part must be in some error, and some cases must have none."""
    errors = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("unknown tool: "), "p_type")), F.when(F.col("p_size") % 3 == 0, F.lit("arguments must be an object"))))
    wanted = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("unknown tool"))).when(F.col("p_partkey") % 4 == 1, F.array(F.lit("object"), F.lit("tool")))
    rows = table(spark, sf_dir, "part").select("p_partkey", errors.alias("errors"), wanted.alias("must_contain"), F.when(F.col("p_partkey") % 4 == 2, True).alias("must_be_valid"))
    return validate.policy_cases(rows).select("p_partkey", "passed")


def tfidf_rows(spark, sf_dir):
    """M2: weights of the items' words and pairs of words, of unit length."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)).alias("terms"))
    return baselines.tfidf_weights(items, "id", "terms", features=500).select("id", "term", F.round("weight", 6).alias("weight"))


def noise_training_texts(spark, sf_dir):
    """The rows of training with their texts, the light level."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("Đặt ở quán phở, "), "text").alias("query"))
    out = build.training_noise(rows, "query", "id", levels={"light": build.MARK_LEVELS["light"]})
    return out.select("id", "query", "noise_level", "clean_query")


def time_of_events(spark, sf_dir):
    """Times said in four ways, some of them impossible."""
    k, h, m = F.col("event_id"), (F.col("event_id") % 26).cast("string"), (F.floor(F.col("event_id") / 26) % 64).cast("string")
    said = F.when(k % 4 == 0, F.concat(F.lit("nhắc tôi lúc "), h, F.lit(" giờ "), m)).when(k % 4 == 1, F.concat(h, F.lit("h"), m, F.lit(" nhé"))).when(k % 4 == 2, F.concat(h, F.lit(" giờ chiều"))).otherwise(F.concat(F.lit("việc số "), h))
    t = X.parse_time(F.col("said"))
    return table(spark, sf_dir, "events").select("event_id", said.alias("said")).select("event_id", t["hour"].cast("bigint").alias("hour"), t["minute"].cast("bigint").alias("minute"))


def hybrid_catalog_order(spark, sf_dir):
    """Ties go to the item that stands earlier in the catalog, which here runs backwards."""
    ranked = R.rank(R.hybrid(retrieval._pairs(spark, sf_dir)), 3, order=[F.col("item").desc()], digits=1)
    return ranked.select("query", "item", "rank", "score")


QUERIES = {f.__name__: f for f in (jsonl_lines, jsonl_marker, jsonl_numbers, imported_rows, written_hash, item_messages, policy_outcomes, tfidf_rows, noise_training_texts, time_of_events, hybrid_catalog_order)}

_ITEMS = """i AS (SELECT p_partkey::BIGINT AS k FROM part),
  m AS (SELECT k, 'i' || (k - CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END)::VARCHAR AS id, 'u ' || (k // 2)::VARCHAR AS utterance, CASE WHEN k % 3 = 0 THEN 'test' ELSE 'train' END AS split, NOT (k % 6 = 5 AND k % 4 = 1) AS is_object FROM i WHERE k % 17 != 0),
  w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) > 1 AS again, CASE WHEN is_object THEN lag(split) OVER (PARTITION BY is_object, utterance ORDER BY k) END AS previous FROM m)"""

ORACLE = {
    "jsonl_lines": "SELECT CASE WHEN event_id % 11 != 0 THEN event_type END AS event_type, count(*) AS n, sum(CASE WHEN event_id % 11 != 0 THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1",
    "jsonl_marker": "SELECT n_name AS id FROM nation WHERE n_regionkey != 2 UNION ALL SELECT '__LOAD_ERROR__'",
    "jsonl_numbers": "SELECT c_custkey, c_name, round(c_acctbal, 2)::DOUBLE AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS segment, true AS in_place FROM customer",
    "imported_rows": "SELECT count(*) FILTER (c_custkey % 13 != 0 AND c_custkey % 4 != 0) AS added, (sum(c_custkey) FILTER (c_custkey % 13 != 0 AND c_custkey % 4 != 0))::BIGINT AS ids, (sum(CASE WHEN c_custkey % 10 = 1 THEN 2 ELSE 1 END))::BIGINT AS read, (sum(CASE WHEN c_custkey % 10 = 1 THEN 2 ELSE 1 END) FILTER (c_custkey % 13 = 0))::BIGINT AS malformed FROM customer",
    "written_hash": "SELECT upper(sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey))) AS sha256 FROM nation",
    "item_messages": f"""WITH {_ITEMS},
      o AS (SELECT k, concat_ws('|', CASE WHEN again THEN 'duplicate id ' || id END, CASE WHEN k % 6 = 3 THEN 'unknown intent' END, CASE WHEN NOT is_object THEN 'arguments must be an object' END,
        CASE WHEN k % 6 = 0 AND k % 4 = 0 THEN 'set_alarm lacks hour' END, CASE WHEN k % 6 = 1 AND k % 4 >= 2 THEN 'set_timer lacks duration_minutes/seconds' END, CASE WHEN k % 6 = 2 AND k % 4 = 0 THEN 'call_contact lacks contact' END,
        CASE WHEN k % 6 = 4 AND k % 4 != 0 THEN 'clarify must name what is missing' END, CASE WHEN previous != split THEN 'utterance leaks between splits ' || previous || ' and ' || split END) AS messages FROM w)
      SELECT k AS line_no, messages FROM o WHERE messages != '' UNION ALL SELECT k, CASE WHEN k % 34 = 0 THEN 'lacks language|lacks split' ELSE 'lacks language' END FROM i WHERE k % 17 = 0""",
    "policy_outcomes": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 3 = 0 AND p_size % 2 = 0 WHEN 2 THEN p_size % 2 != 0 AND p_size % 3 != 0 ELSE true END AS passed FROM part",
    "tfidf_rows": """WITH t AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM benchmark), n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL),
      d AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY term ORDER BY total DESC, term LIMIT 500), w AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN d USING (term), n)
      SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""",
    "noise_training_texts": f"""WITH x AS (SELECT item_id::VARCHAR AS id, 'Đặt ở quán phở, ' || text AS query FROM benchmark), n AS ({datasets.noisy_sql("id || '/light'", "SELECT id AS item_id, query AS t FROM x", 0.25, 0.10, 0.05)})
      SELECT id, query, NULL::VARCHAR AS noise_level, NULL::VARCHAR AS clean_query FROM x UNION ALL SELECT id || '_noisy_light', noisy, 'light', query FROM x JOIN n ON n.item_id = x.id""",
    "time_of_events": """WITH t AS (SELECT event_id, event_id % 4 AS way, event_id % 26 AS h, (event_id // 26) % 64 AS m FROM events),
      u AS (SELECT event_id, CASE WHEN way = 3 THEN NULL WHEN way = 2 AND h BETWEEN 1 AND 11 THEN h + 12 ELSE h END AS h, CASE WHEN way < 2 THEN m ELSE 0 END AS m FROM t)
      SELECT event_id, CASE WHEN h <= 23 AND m <= 59 THEN h END AS hour, CASE WHEN h <= 23 AND m <= 59 THEN m END AS minute FROM u""",
    "hybrid_catalog_order": f"WITH {retrieval._P}, o AS (SELECT query, item, round(score, 1) AS score FROM hy), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item DESC) AS rank FROM o) SELECT query, item, rank, score FROM k WHERE rank <= 3",
}
