"""Filters, joins, aggregates, windows and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import skew
from tidemill.plans.registry import query, table


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count(F.lit(1)).alias("count_order"),
    )


@query(
    "revenue_by_segment",
    """SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM customer
    JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment""",
)
def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, li = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    # a line's revenue is added up by order before it meets the customers
    by_order = li.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.count(F.lit(1)).alias("n"))
    joined = by_order.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("n").alias("n_lines"))


@query(
    "top_orders",
    """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'O' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""",
)
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "revenue").orderBy(F.desc("revenue"), "o_orderkey").limit(10)


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query(
    "full_outer_join",
    """SELECT coalesce(c.k, s.k) AS nationkey, coalesce(nc, 0) AS n_customers, coalesce(ns, 0) AS n_suppliers FROM
    (SELECT c_nationkey AS k, count(*) AS nc FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS ns FROM supplier GROUP BY 1) s ON c.k = s.k""",
)
def full_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("nc"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("ns"))
    return c.join(s, "k", "full").select(F.col("k").alias("nationkey"), F.coalesce("nc", F.lit(0)).alias("n_customers"), F.coalesce("ns", F.lit(0)).alias("n_suppliers"))


@query(
    "cube",
    """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g1, CAST(grouping(l_linestatus) AS BIGINT) AS g2, round(sum(l_quantity), 2) AS qty
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.round(F.sum("l_quantity"), 2).alias("qty")
    )


@query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pivot",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
    FROM orders GROUP BY o_orderpriority""",
)
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(x, F.lit(0)).alias(x.lower()) for x in "FOP"))


@query(
    "top_per_group",
    """SELECT c_mktsegment, c_custkey, rk FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) t WHERE rk <= 3""",
)
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).cast("long").alias("rk")).where("rk <= 3")


@query(
    "window_frames",
    """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth,
    lag(o_orderkey) OVER w AS before, first_value(o_orderkey) OVER w AS first_one, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-1, 1)), 4).alias("smooth"),
        F.lag("o_orderkey").over(w).alias("before"), F.first("o_orderkey").over(w).alias("first_one"), F.ntile(4).over(w).cast("long").alias("quarter"),
    )


@query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query(
    "correlated_average",
    """SELECT l_partkey, count(*) AS n FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey) GROUP BY l_partkey""",
)
def correlated_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    mean = li.groupBy("l_partkey").agg((0.5 * F.avg("l_quantity")).alias("m"))  # a map-side sum, then a join with a row a part
    return li.join(mean, "l_partkey").where("l_quantity < m").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "several_distinct",
    "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed FROM lineitem GROUP BY l_returnflag",
)
def several_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_tax") > 0.04).alias("taxed")
    )


@query(
    "salted_join",
    """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    with_nation = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), "n_name")
    joined = skew.salted_join(o.select(F.col("o_custkey").alias("k"), "o_totalprice"), with_nation, "k", salts=8)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_CHAIN = """WITH RECURSIVE o AS (SELECT {key} AS k, {region} AS r, {name} AS name, row_number() OVER (PARTITION BY {region} ORDER BY {key}) AS i FROM {nation}),
    t(r, i, chain) AS (SELECT r, CAST(1 AS BIGINT), name FROM o WHERE i = 1 UNION ALL SELECT t.r, t.i + 1, concat(t.chain, '>', o.name) FROM t JOIN o ON o.r = t.r AND o.i = t.i + 1)
    SELECT r AS n_regionkey, i, chain FROM t"""
_NATION = {"key": "n_nationkey", "region": "n_regionkey", "name": "n_name"}


@query("recursive_series", _CHAIN.format(nation="nation", **_NATION))
def recursive_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of each region's nations, every one with its next nation added."""
    return spark.sql(_CHAIN.format(nation=f"parquet.`{sf_dir}/nation.parquet`", **_NATION))


@query(
    "lateral_best_line",
    """SELECT o_orderkey, best FROM orders, LATERAL (SELECT max(l_extendedprice) AS best FROM lineitem WHERE l_orderkey = o_orderkey) t WHERE o_orderpriority LIKE '1%'""",
)
def lateral_best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("best"))
    return table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").join(best, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "best")
