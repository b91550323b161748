"""More aggregates and window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.plans.registry import query, table


@query(
    "grouping_sets",
    """SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
)
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return li.groupingSets([[a, b], [a], []], a, b).agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n"))


@query(
    "collecting_aggregates",
    """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, max_by(n_name, n_nationkey) AS last_one, min_by(n_name, n_nationkey) AS first_one,
    CAST(len(array_agg(n_nationkey)) AS BIGINT) AS n, bool_and(n_nationkey >= 0) AS all_ok, bool_or(n_nationkey > 20) AS some_high, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey""",
)
def collecting_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.max_by("n_name", "n_nationkey").alias("last_one"), F.min_by("n_name", "n_nationkey").alias("first_one"),
        F.size(F.array_agg("n_nationkey")).cast("long").alias("n"), F.bool_and(F.col("n_nationkey") >= 0).alias("all_ok"), F.bool_or(F.col("n_nationkey") > 20).alias("some_high"),
        F.bit_xor("n_nationkey").alias("x"),
    )


@query(
    "percentiles",
    """SELECT o_orderpriority, round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, quantile_disc(o_totalprice, 0.25) AS d25, any_value(o_orderpriority) AS any_one FROM orders GROUP BY o_orderpriority""",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.round(F.median("o_totalprice"), 4).alias("mid"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"),
        F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice)").alias("d25"), F.any_value("o_orderpriority").alias("any_one"),
    )


@query(
    "correlations",
    """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs,
    round(regr_intercept(l_extendedprice, l_quantity), 3) AS b, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag""",
)
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.covar_pop("l_quantity", "l_discount"), 6).alias("cp"), F.round(F.covar_samp("l_quantity", "l_tax"), 6).alias("cs"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("b"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
    )


@query("most_frequent", "SELECT l_linestatus, mode(l_returnflag) AS flag FROM lineitem GROUP BY l_linestatus")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.mode("l_returnflag", True).alias("flag"))


@query(
    "sketches",
    "SELECT l_returnflag, true AS hll_near, true AS kll_near, true AS percentile_near, true AS theta_near FROM lineitem GROUP BY l_returnflag",
)
def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sketches, merged over partial ones, are within 5 % of the exact figures."""
    li = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice"))
    parts = li.groupBy("l_returnflag", "l_linestatus").agg(F.hll_sketch_agg("l_orderkey").alias("h"), F.theta_sketch_agg("l_orderkey").alias("t"), F.kll_sketch_agg_double("price").alias("k"))
    merged = parts.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("h")).alias("h"), F.theta_sketch_estimate(F.theta_union_agg("t")).alias("t"))
    keys = li.select("l_returnflag", "l_orderkey").distinct().groupBy("l_returnflag").agg(F.count("l_orderkey").alias("d"))  # apart, or each order would have sketches of its own
    exact = keys.join(li.groupBy("l_returnflag").agg(
        F.percentile("price", 0.5).alias("mid"), F.percentile_approx("price", 0.5, 10000).alias("approx"), F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("price"), F.lit(0.5)).alias("k"),
        F.percentile("price", F.array(F.lit(0.44), F.lit(0.56))).alias("about"),
    ), "l_returnflag")
    within = lambda x: (F.col(x) >= F.col("about")[0]) & (F.col(x) <= F.col("about")[1])
    near = lambda x: F.abs(F.col(x) - F.col("d")) <= 0.05 * F.col("d")
    return exact.join(merged, "l_returnflag").select("l_returnflag", near("h").alias("hll_near"), within("k").alias("kll_near"), within("approx").alias("percentile_near"), near("t").alias("theta_near"))


@query(
    "unpivot",
    """SELECT l_returnflag, 'qty' AS name, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'price', round(sum(l_extendedprice), 2) FROM lineitem GROUP BY 1""",
)
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return wide.unpivot("l_returnflag", ["qty", "price"], "name", "value")


@query(
    "transpose",
    """SELECT 'n' AS key, max(n) FILTER (WHERE s = 'F') AS f, max(n) FILTER (WHERE s = 'O') AS o, max(n) FILTER (WHERE s = 'P') AS p FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) t""",
)
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows whatever the data's size become three columns."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.transpose("o_orderstatus")
    return wide.select("key", *(F.col(x).alias(x.lower()) for x in "FOP"))


@query(
    "first_order_of_each",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) t WHERE rn = 1",
)
def first_order_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate with a map-side part instead of a sort of each customer's orders."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "m.o_orderkey", "m.o_orderdate")


@query(
    "ranking",
    """SELECT s_suppkey, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
    FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000))""",
)
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.round(F.col("s_acctbal") / 1000))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd")
    )


@query(
    "offsets",
    """SELECT o_orderkey, lead(o_orderkey, 2, -1) OVER w AS later, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_one,
    last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_one FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lead("o_orderkey", 2, -1).over(w).alias("later"), F.nth_value("o_orderkey", 2).over(whole).alias("second_one"), F.last("o_orderkey").over(whole).alias("last_one")
    )


@query(
    "range_interval",
    """SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS total FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)""",
)
def range_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW)"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"count(1) {w} AS n", f"round(sum(o_totalprice) {w}, 2) AS total")


@query(
    "share_of_total",
    "SELECT c_mktsegment, n_regionkey, round(sum(c_acctbal), 2) AS held, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (PARTITION BY n_regionkey), 6) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
)
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = c.groupBy("c_mktsegment", "n_regionkey").agg(F.sum("c_acctbal").alias("s"))
    return sums.select("c_mktsegment", "n_regionkey", F.round("s", 2).alias("held"), F.round(F.col("s") / F.sum("s").over(Window.partitionBy("n_regionkey")), 6).alias("share"))
