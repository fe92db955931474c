"""Smoke queries on the order tables, and event-time extensions that the blueprint doesn't have."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans._tables import table
from tessera.streaming import windows


def tpch_pricing(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def tpch_star(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "o_orderpriority").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def tpch_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 10").select("o_orderpriority", "rank", "o_orderkey", "o_totalprice")


def tpch_anti(spark, sf_dir):
    """Customers without an urgent order."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def tpch_semi(spark, sf_dir):
    late = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    return table(spark, sf_dir, "orders").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def ext_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value").select("start", "event_type", "n", F.round("total", 4).alias("total"))


def ext_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "start", "n")


def ext_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (tpch_pricing, tpch_star, tpch_topk, tpch_anti, tpch_semi, ext_tumbling, ext_sessions, ext_cube)}

ORACLE = {
    "tpch_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "tpch_star": "SELECT r_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "tpch_topk": "SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey, o_totalprice FROM orders QUALIFY rank <= 10",
    "tpch_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "tpch_semi": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1",
    "ext_tumbling": "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ext_sessions": "WITH l AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 minute OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s",
    "ext_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
