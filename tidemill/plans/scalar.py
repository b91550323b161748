"""Scalar functions: strings, dates, numbers, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.registry import query, table


@query(
    "strings",
    """SELECT c_custkey, lower(c_name) AS low, CAST(length(c_name) AS BIGINT) AS n, substring(c_name, 1, 4) AS head, lpad(c_mktsegment, 12, '*') AS padded, reverse(c_mktsegment) AS back,
    replace(c_name, '#', '-') AS dashed, regexp_replace(c_name, '[0-9]', '', 'g') AS letters, md5(c_name) AS hash, CAST(levenshtein(c_mktsegment, 'MACHINERY') AS BIGINT) AS far FROM customer""",
)
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.lower(name).alias("low"), F.length(name).cast("long").alias("n"), F.substring(name, 1, 4).alias("head"), F.lpad(seg, 12, "*").alias("padded"), F.reverse(seg).alias("back"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("dashed"), F.regexp_replace(name, "[0-9]", "").alias("letters"), F.md5(name).alias("hash"), F.levenshtein(seg, F.lit("MACHINERY")).cast("long").alias("far"),
    )


@query(
    "dates",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(dayofyear(o_orderdate) AS BIGINT) AS d, date_trunc('month', o_orderdate) AS month_start,
    CAST(o_orderdate AS DATE) AS day, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders""",
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofyear(d).cast("long").alias("d"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"),
        d.cast("date").alias("day"), F.date_diff(d.cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("days"),
    )


@query(
    "numbers",
    """SELECT p_partkey, round(p_retailprice / 7, 4) AS part, floor(p_retailprice)::BIGINT AS low, ceil(p_retailprice)::BIGINT AS high, round(ln(p_retailprice + 1), 6) AS log, p_partkey % 7 AS rest,
    round(sqrt(p_size), 6) AS root, greatest(p_size, 20) AS most, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'middle' ELSE 'large' END AS kind FROM part""",
)
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(price / 7, 4).alias("part"), F.floor(price).alias("low"), F.ceil(price).alias("high"), F.round(F.log(price + 1), 6).alias("log"), (F.col("p_partkey") % 7).alias("rest"),
        F.round(F.sqrt(size), 6).alias("root"), F.greatest(size, F.lit(20)).alias("most"), F.when(size < 15, "small").when(size < 35, "middle").otherwise("large").alias("kind"),
    )


@query(
    "arrays",
    """SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS head, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total,
    CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings""",
)
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("n"), F.round(F.element_at(e, 1).cast("double"), 6).alias("head"),
        F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
    )


@query("json", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT props) AS kinds FROM events GROUP BY event_type")
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.countDistinct("props").alias("kinds"))


@query(
    "statistics",
    """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    quantile_cont(l_extendedprice, 0.5) AS middle, max(l_tax) AS most FROM lineitem GROUP BY l_returnflag""",
)
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.median("l_extendedprice").alias("middle"), F.max("l_tax").alias("most"),
    )
