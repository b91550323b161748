"""Event-time queries in batch: as-of and interval joins, sessions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import temporal
from tidemill.plans.registry import query, table


@query(
    "asof_join",
    """SELECT p.event_id, e.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') e ON p.user_id = e.user_id AND p.ts >= e.ts""",
)
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("vt"), F.col("event_id").alias("view_id"))
    return temporal.asof_join(bought, seen, ["user_id"], "ts", "vt", ["view_id"]).select("event_id", "view_id")


@query(
    "interval_join",
    """SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR
    WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
)
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("ta"), F.col("event_id").alias("click_id"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("tb"), F.col("event_id").alias("purchase_id"))
    return temporal.interval_join(a, b, ["user_id"], "ta", "tb", "0 hours", "6 hours", 6 * 3600).select("click_id", "purchase_id")


@query(
    "sessions",
    """SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM
    (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000 AS BIGINT), 0) AS fresh FROM events) x) y GROUP BY user_id, session""",
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = temporal.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 7200)
    return got.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    "sliding_windows",
    """SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts)]) AS start FROM events) t GROUP BY start""",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "30 minutes", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
