"""Relational, analytic and windowed queries that come with the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.sources import tables as t
from braidwork.streaming import indexing

from .registry import Registry

Q = Registry()
_l = lambda s, d: t.table(s, d, "lineitem")
Q.add(
    "ext_pricing_summary",
    lambda s, d: _l(s, d).where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n")),
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
)


def _star(s: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (t.table(s, d, x) for x in ("orders", "customer", "nation", "region"))
    lines = _l(s, d).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return lines.join(o, lines.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


Q.add("ext_star_join", _star, """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")  # fmt: skip
Q.add("ext_semi_join", lambda s, d: t.table(s, d, "customer").join(t.table(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
Q.add("ext_anti_join", lambda s, d: t.table(s, d, "customer").join(t.table(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
Q.add("ext_full_join", lambda s, d: t.table(s, d, "customer").where("c_acctbal > 0").select("c_custkey").join(t.table(s, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_custkey", "n"),
      "SELECT c_custkey, o_custkey, n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
Q.add("ext_cube", lambda s, d: _l(s, d).cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.grouping_id().alias("g")), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
Q.add("ext_distinct_agg", lambda s, d: _l(s, d).groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts")), "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _approx(s: SparkSession, d: str) -> DataFrame:
    """Whether sketches are within five of their standard errors of the exact values.

    Each is an aggregate of its own: beside a distinct count, Spark would keep a sketch for each part of a flag."""
    rows, flag = _l(s, d), F.col("l_returnflag").alias("flag")
    near = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("l_quantity", 0.5, 10_000).alias("median"))
    parts = rows.select(flag, "l_partkey").distinct().groupBy("flag").agg(F.count("l_partkey").alias("parts"))
    middle = rows.groupBy(flag, "l_quantity").agg(F.count("*").alias("n")).groupBy("flag").agg(F.percentile("l_quantity", 0.5, F.col("n")).alias("m"))
    same = lambda other: F.col("l_returnflag").eqNullSafe(other["flag"])
    got = near.join(parts, same(parts)).join(middle, same(middle))
    return got.select("l_returnflag", "parts", (F.abs(F.col("a") - F.col("parts")) <= 0.1 * F.col("parts")).alias("parts_near"), (F.abs(F.col("median") - F.col("m")) <= 1).alias("median_near"))


Q.add("ext_approx", _approx, "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, TRUE AS parts_near, TRUE AS median_near FROM lineitem GROUP BY 1")
Q.add("ext_having", lambda s, d: _l(s, d).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 150"), "SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 150")
_keys = lambda s, d, c: _l(s, d).where(c).select("l_suppkey")
Q.add("ext_intersect", lambda s, d: _keys(s, d, "l_quantity > 49").intersect(_keys(s, d, "l_discount > 0.09")), "SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09")
Q.add("ext_except", lambda s, d: t.table(s, d, "supplier").select("s_suppkey").exceptAll(_keys(s, d, "l_quantity = 50 and l_discount > 0.08").distinct().select(F.col("l_suppkey").alias("s_suppkey"))), "SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08")
_w = lambda: Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
Q.add("ext_top_per_group", lambda s, d: t.table(s, d, "orders").withColumn("rn", F.row_number().over(_w())).where("rn <= 3").select("o_custkey", "o_orderkey", "rn"), "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 3")
Q.add("ext_window_frame", lambda s, d: t.table(s, d, "events").withColumn("avg3", F.round(F.avg("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)), 6)).select("event_id", "avg3"), "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS avg3 FROM events")
Q.add("ext_tumbling", lambda s, d: indexing.windowed(t.table(s, d, "events")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
Q.add("ext_sliding", lambda s, d: indexing.windowed(t.table(s, d, "events"), slide="30 minutes").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"),
      """WITH h AS (SELECT *, CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS TIMESTAMP) AS b FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total
      FROM (SELECT b AS start, event_type, value FROM h UNION ALL SELECT b - INTERVAL 30 MINUTE, event_type, value FROM h) GROUP BY ALL""")  # fmt: skip
Q.add("ext_json", lambda s, d: t.table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n")), "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
Q.add("ext_pivot", lambda s, d: t.table(s, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1))).select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).cast("long").alias("urgent"), F.coalesce("5-LOW", F.lit(0)).cast("long").alias("low")),
      "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")


def _as_of(s: SparkSession, d: str) -> DataFrame:
    """The last view before each purchase of a user, by one union and one window instead of a range join."""
    e = t.table(s, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "last_view")


Q.add("ext_as_of", _as_of, "SELECT event_id, last_view FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events) WHERE event_type = 'purchase'")


def _sql(s: SparkSession, d: str) -> DataFrame:
    """The SQL surface over registered views."""
    return s.sql("SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM {part} GROUP BY p_brand HAVING count(*) > 1", part=t.table(s, d, "part"))


Q.add("ext_sql", _sql, "SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand HAVING count(*) > 1")
