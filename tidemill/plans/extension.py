"""User-defined functions, aggregates, table functions and sources; file formats."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.plans.registry import query, table
from tidemill.sources import calendar, formats
from tidemill.sources.shared import fresh, input_bytes

cloudpickle.register_pickle_by_value(calendar)  # executors needn't have this package


@query("pandas_udf", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM documents")
def pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters without their accents: what Spark has no function for."""

    def bare(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.pandas_udf(bare, "string")("text")).alias("plain"))


@query(
    "grouped_map",
    """WITH n AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_custkey, round(sum(CASE WHEN i = 1 THEN x * pow(0.7, n - 1) ELSE 0.3 * x * pow(0.7, n - i) END), 2) AS smoothed FROM n GROUP BY o_custkey""",
)
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential smoothing of each customer's orders: every value depends on the one before. A group is a bucket of customers, of about 8 MB."""

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o_custkey", "o_orderdate", "o_orderkey"])
        customer, price = rows["o_custkey"].to_numpy(), rows["o_totalprice"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], customer[1:] != customer[:-1])))
        length, s = np.diff(np.append(first, len(customer))), price[first]
        for k in range(1, int(length.max())):  # the k-th order of all customers that have so many
            more = length > k
            s[more] = 0.3 * price[first[more] + k] + 0.7 * s[more]
        return pd.DataFrame({"o_custkey": customer[first], "smoothed": s})

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(o) >> 23)
    by = F.pmod(F.xxhash64("o_custkey"), F.lit(buckets))
    return o.groupBy(by.alias("bucket")).applyInPandas(smooth, "o_custkey long, smoothed double").withColumn("smoothed", F.round("smoothed", 2))


@query("grouped_aggregate", "SELECT o_custkey, round(exp(avg(ln(o_totalprice))), 2) AS geometric FROM orders GROUP BY o_custkey")
def grouped_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def geometric(x: pd.Series) -> float:
        return float(np.exp(np.log(x).mean()))

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.pandas_udf(geometric, "double")("o_totalprice"), 2).alias("geometric"))


@query(
    "cogrouped",
    """SELECT p.event_id, e.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') e ON p.user_id = e.user_id AND p.ts >= e.ts""",
)
def cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click before each purchase; a group is one day of a bucket of users, and what is known the day before carries the last click over."""

    def latest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"event_id": [], "click_id": []}, dtype="Int64")
        b = b.rename(columns={"event_id": "click_id"})[["ts", "user_id", "click_id"]].astype({"click_id": "Int64"}).sort_values("ts")
        met = pd.merge_asof(a.sort_values("ts")[["ts", "user_id", "event_id"]], b, on="ts", by="user_id")
        return pd.DataFrame({"event_id": met["event_id"].astype("Int64"), "click_id": met["click_id"].astype("Int64")})

    e = table(spark, sf_dir, "events")
    buckets = max(1, input_bytes(e) >> 27)
    e = e.select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket"))
    days = e.groupBy("user_id", "bucket", "day").agg(F.max(F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))).alias("m"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("m", F.last("m", ignorenulls=True).over(before)).where("m is not null").select("user_id", "bucket", "day", "m.ts", "m.event_id")
    known = e.where("event_type = 'click'").select("user_id", "bucket", "day", "ts", "event_id").unionByName(carried)
    bought = e.where("event_type = 'purchase'").select("user_id", "bucket", "day", "ts", "event_id")
    return bought.groupBy("bucket", "day").cogroup(known.groupBy("bucket", "day")).applyInPandas(latest, "event_id long, click_id long")


@query("table_function", "SELECT event_id, CAST(i AS BIGINT) AS digit_at, substr(CAST(event_id AS VARCHAR), CAST(i AS INTEGER), 1) AS digit FROM events, generate_series(1, 9) t(i) WHERE i <= length(CAST(event_id AS VARCHAR))")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function beside each row, as a lateral join."""

    @F.udtf(returnType="digit_at: bigint, digit: string")
    class Digits:
        def eval(self, number: int) -> Iterator[tuple]:
            yield from enumerate(str(number), 1)

    e = table(spark, sf_dir, "events").select("event_id")
    return e.lateralJoin(Digits(F.col("event_id").outer())).select("event_id", "digit_at", "digit")


@query(
    "python_source",
    """SELECT CAST(weekofyear(o_orderdate) AS INTEGER) AS week, isodow(o_orderdate) > 5 AS weekend, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""",
)
def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by week and part of the week, with the days of their years from a Python source."""
    spark.dataSource.register(calendar.CalendarSource)
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    first, last = o.agg(F.min(F.year("day")), F.max(F.year("day"))).first()
    days = spark.read.format("calendar").option("first", first or 2000).option("last", last or 2000).load()
    by_day = o.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return by_day.join(days, "day").groupBy("week", "weekend").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("format_round_trip", "SELECT r_name, n_name, CAST(n_nationkey AS BIGINT) AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def format_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", F.col("n_nationkey").cast("long").alias("k"))
    for kind in ("csv", "json", "orc", "xml", "parquet"):
        at = fresh(spark, "formats")
        formats.write(rows, at, kind)
        rows = formats.read(spark, at, kind, rows.schema)
    return rows


@query("text_lines", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh(spark, "formats")
    formats.write(table(spark, sf_dir, "nation").select(F.concat_ws("\t", "n_nationkey", "n_name").alias("value")), at, "text")
    line = F.split("value", "\t")
    return spark.read.text(at).select(F.element_at(line, 1).cast("int").alias("k"), F.element_at(line, 2).alias("name"))


@query("partitioned_write", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a folder for each status; the filter reads one folder."""
    at = fresh(spark, "orders")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    formats.write(orders, at, "parquet", ["o_orderstatus"])
    kept = formats.read(spark, at, "parquet", orders.schema).where("o_orderstatus = 'F'")
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
