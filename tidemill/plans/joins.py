"""More kinds of joins, set operations and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.registry import query, table


@query(
    "null_safe_join",
    """WITH c AS (SELECT nullif(c_nationkey, 0) AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT nullif(s_nationkey, 0) AS k, count(*) AS n FROM supplier GROUP BY 1)
    SELECT c.k, c.n AS nc, s.n AS ns FROM c JOIN s ON c.k IS NOT DISTINCT FROM s.k""",
)
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t, k, n: table(spark, sf_dir, t).groupBy(F.nullif(F.col(k), F.lit(0)).alias(f"k{n}")).agg(F.count(F.lit(1)).alias(n))
    c, s = of("customer", "c_nationkey", "nc"), of("supplier", "s_nationkey", "ns")
    return c.join(s, F.col("knc").eqNullSafe(F.col("kns"))).select(F.col("knc").alias("k"), "nc", "ns")


@query("right_join", "SELECT n_nationkey, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey")
def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    return s.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"))


@query("cross_join", "SELECT r_name, s.o_orderstatus AS status FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region with every status: both are a handful whatever the data's size."""
    status = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")).distinct()
    return table(spark, sf_dir, "region").select("r_name").crossJoin(status)


@query(
    "range_join",
    """SELECT b.band, count(*) AS n FROM supplier JOIN (VALUES (1, -1000, 0), (2, 0, 2500), (3, 2500, 5000), (4, 5000, 10001)) b(band, lo, hi)
    ON s_acctbal >= b.lo AND s_acctbal < b.hi GROUP BY b.band""",
)
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theta join with a fixed table of bands: a nested loop over four rows."""
    bands = spark.sql("SELECT * FROM VALUES (1, -1000, 0), (2, 0, 2500), (3, 2500, 5000), (4, 5000, 10001) AS b(band, lo, hi)")
    s = table(spark, sf_dir, "supplier")
    return s.join(bands, (F.col("s_acctbal") >= F.col("lo")) & (F.col("s_acctbal") < F.col("hi"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("join_hints", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment")
def join_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    met = o.join(c.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).join(n.hint("merge"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "not_in_with_null",
    """SELECT (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)) AS with_null,
    (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)) AS without_null""",
)
def not_in_with_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = (f"parquet.`{sf_dir}/{t}.parquet`" for t in ("customer", "supplier"))
    return spark.sql(
        f"""SELECT (SELECT count(*) FROM {c} WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM {s})) AS with_null,
        (SELECT count(*) FROM {c} WHERE c_nationkey NOT IN (SELECT s_nationkey FROM {s} WHERE s_acctbal > 9000)) AS without_null"""
    )


@query(
    "predicates",
    """SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice > 950 AND p_name ILIKE '%A%' AND (p_size IN (7, 9, 11, NULL) OR p_type NOT LIKE '%S%') AND NOT (p_size = 8)""",
)
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where(F.col("p_size").between(5, 30) & (F.col("p_retailprice") > 950))
    return p.where(F.col("p_name").ilike("%A%") & (F.expr("p_size IN (7, 9, 11, NULL)") | ~F.col("p_type").like("%S%")) & (F.col("p_size") != 8)).select("p_partkey")


@query("union_distinct", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(
    "union_by_name",
    "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS size FROM customer WHERE c_acctbal < 0 UNION ALL SELECT p_partkey, p_name, CAST(p_size AS DOUBLE) FROM part WHERE p_size < 5",
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_size").cast("double").alias("size"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(p, allowMissingColumns=True)


@query("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("except_distinct", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).subtract(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"))


@query(
    "lateral_join",
    """SELECT c_custkey, t.n, t.largest FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS largest FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') t WHERE c_acctbal > 8000""",
)
def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = (f"parquet.`{sf_dir}/{t}.parquet`" for t in ("customer", "orders"))
    return spark.sql(
        f"""SELECT c_custkey, t.n, t.largest FROM {c}, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS largest FROM {o}
        WHERE o_custkey = c_custkey AND o_orderstatus = 'F') t WHERE c_acctbal > 8000"""
    )


@query(
    "exists_in_having",
    """SELECT o_custkey, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5) GROUP BY o_custkey
    HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) t)""",
)
def exists_in_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 5")
    mean = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean"))
    some = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return some.crossJoin(mean).where("n > mean").select("o_custkey", "n")  # the mean is one row
