"""Structured Streaming, replayed over the event table in several batches with events out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.registry import query, table
from tidemill.streaming import events, replay, timers


def source(spark: SparkSession, sf_dir: str, *closing: str) -> DataFrame:
    """The events in five slices of time, one in seven of them a slice late; then an event of each `closing` type far ahead."""
    return replay.as_stream(spark, replay.arrivals(table(spark, sf_dir, "events"), list(closing)))


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """Groups of users that share a key of state: of a million events or so, however many there are."""
    return max(8, table(spark, sf_dir, "events").count() // 1_000_000)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay.replayed(events.counted(source(spark, sf_dir), "1 hour", "10 minutes"), "complete")
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_sliding",
    """SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts)]) AS start FROM events) t GROUP BY start, event_type""",
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay.replayed(events.counted(source(spark, sf_dir), "1 hour", "10 minutes", "30 minutes"), "complete")
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    """SELECT user_id, min(ts) AS start, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM
    (SELECT *, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 7200000000 AS BIGINT), 0) AS fresh FROM events) x) y GROUP BY user_id, session""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay.replayed(events.sessions(source(spark, sf_dir), "2 hours", "10 minutes"), "complete")
    return got.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "first_event")


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) t GROUP BY 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay.replayed(events.deduplicated(source(spark, sf_dir), ["user_id", "event_type"], "40 days"))
    return got.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_join",
    """SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
    WHERE a.event_type = 'view' AND b.event_type = 'purchase'""",
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = source(spark, sf_dir)
    first, second = (got.where(F.col("event_type") == x) for x in ("view", "purchase"))
    return replay.replayed(events.followed(first, second, "1 hour", "7 days")).select("first_id", "second_id")


@query(
    "stream_outer_join",
    """SELECT a.event_id AS first_id, b.event_id AS second_id FROM (SELECT * FROM events WHERE event_type = 'view') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b
    ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""",
)
def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view with the purchases that follow it, or with null, given as the watermark evicts it from the join's state."""
    got = source(spark, sf_dir, "view", "purchase")
    first, second = (got.where(F.col("event_type") == x) for x in ("view", "purchase"))
    return replay.replayed(events.followed(first, second, "1 hour", "7 days", "leftOuter")).select("first_id", "second_id")


#: Of eleven events one comes a slice late, one two and one three.
_BEHIND = "int(greatest(0, 7919 * event_id % 11 - 7))"
_LATE_SQL = """WITH s AS (SELECT *, least(4, floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 5 / CAST(max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1 AS DOUBLE)) + greatest(0, 7919 * event_id % 11 - 7)) AS slice FROM events),
    m AS (SELECT slice, max(ts) AS newest FROM s GROUP BY slice), d AS (SELECT s.*, time_bucket(INTERVAL 1 HOUR, ts) AS start, (SELECT max(newest) FROM m WHERE m.slice <= s.slice - 2) - INTERVAL 3 DAY AS mark FROM s)"""


@query(
    "stream_late_rows",
    _LATE_SQL + " SELECT start, event_type, count(*) FILTER (WHERE mark IS NULL OR start + INTERVAL 1 HOUR > mark) AS n FROM d GROUP BY 1, 2 HAVING count(*) FILTER (WHERE mark IS NULL OR start + INTERVAL 1 HOUR > mark) > 0",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts in append mode behind a moving watermark: a window comes once, as it is evicted, without the events that were too late.

    An event is too late if its window had ended before the watermark of the batch before its own, which is what the batches
    before that had seen less three days."""
    arrived = replay.arrivals(table(spark, sf_dir, "events"), ["view"], behind=_BEHIND)
    got = replay.replayed(events.counted(replay.as_stream(spark, arrived), "1 hour", "3 days"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_state", "SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replay.replayed(events.running_totals(source(spark, sf_dir)), "update")
    return got.groupBy("user_id").agg(F.max_by(F.struct("n", "most"), "batch").alias("m")).select("user_id", "m.n", "m.most")


@query(
    "stream_timers",
    """SELECT user_id, event_id, ts FROM events a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR)""",
)
def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that no purchase of the same user follows within an hour, given by event-time timers."""
    with timers.rocksdb(spark):
        got = replay.replayed(timers.unanswered(source(spark, sf_dir, "view"), "view", "purchase", 3600, "7 days", buckets=buckets(spark, sf_dir)))
    return got.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_first_seen", "SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY user_id, event_type")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's kinds of events, given once by state that lives for a day of processing time."""
    with timers.rocksdb(spark):
        got = replay.replayed(timers.first_seen(source(spark, sf_dir), 86_400_000, buckets(spark, sf_dir)), idle=False)
    return got.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
