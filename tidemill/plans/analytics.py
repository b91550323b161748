"""Overlaps, global order, funnels, distinct counts that add up, frequent values, time grids, laid-out tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import distinct, funnels, gaps, ordering, overlaps, temporal
from tidemill.plans.registry import query, table
from tidemill.sources import formats, journal
from tidemill.sources.shared import fresh


@query(
    "overlap_join",
    """WITH w AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS s, epoch_us(coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate + INTERVAL 30 DAY)) AS e FROM orders),
    f AS (SELECT o_custkey, o_orderkey AS other, epoch_us(min(l_shipdate)) AS s2, epoch_us(max(l_shipdate)) AS e2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT w.o_orderkey, f.other, least(e, e2) - greatest(s, s2) AS shared_us FROM w JOIN f USING (o_custkey) WHERE s <= e2 AND s2 <= e""",
)
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the orders of its customer that were being shipped before the customer's next order; shipping takes from a day to years."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    waits = o.select("o_custkey", "o_orderkey", us(F.col("o_orderdate")).alias("s"), us(F.coalesce(following, F.col("o_orderdate") + F.expr("interval 30 days"))).alias("e"))
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(us(F.min("l_shipdate")).alias("s2"), us(F.max("l_shipdate")).alias("e2"))
    other = shipped.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("other"), "s2", "e2")
    got = overlaps.overlap_join(waits, other, ["o_custkey"], ("s", "e"), ("s2", "e2"), base=86_400_000_000)
    return got.select("o_orderkey", "other", (F.least("e", "e2") - F.greatest("s", "s2")).alias("shared_us"))


@query(
    "global_order",
    """SELECT o_orderkey, row_number() OVER w AS row_number, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cents_so_far
    FROM orders WINDOW w AS (ORDER BY o_totalprice, o_orderkey)""",
)
def global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's place among all by price, and the running total, without a task that sees them all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return ordering.numbered(o, ["o_totalprice", "o_orderkey"], "cents").select("o_orderkey", "row_number", F.col("running_total").alias("cents_so_far"))


@query(
    "exact_quantiles",
    """SELECT l_returnflag, unnest(CAST([0.0, 0.25, 0.5, 0.9, 0.999] AS DOUBLE[])) AS q, count(*) AS n, unnest(quantile_disc(l_extendedprice, [0.0, 0.25, 0.5, 0.9, 0.999])) AS discrete,
    round(unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.9, 0.999])), 6) AS continuous FROM lineitem GROUP BY l_returnflag""",
)
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ordering.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.25, 0.5, 0.9, 0.999])
    return got.withColumn("continuous", F.round("continuous", 6))


@query(
    "funnel",
    """WITH v AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT v.user_id, v.ts AS t0, min(e.ts) AS t1 FROM v JOIN events e ON e.user_id = v.user_id AND e.event_type = 'click' AND e.ts > v.ts AND e.ts <= v.ts + INTERVAL 12 HOUR GROUP BY 1, 2),
    p AS (SELECT DISTINCT c.user_id FROM c JOIN events e ON e.user_id = c.user_id AND e.event_type = 'purchase' AND e.ts > c.t1 AND e.ts <= c.t0 + INTERVAL 12 HOUR)
    SELECT u.user_id, CAST(CASE WHEN u.user_id IN (SELECT user_id FROM p) THEN 3 WHEN u.user_id IN (SELECT user_id FROM c) THEN 2 WHEN u.user_id IN (SELECT user_id FROM v) THEN 1 ELSE 0 END AS BIGINT) AS level FROM (SELECT DISTINCT user_id FROM events) u""",
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user got from a view over a click to a purchase within half a day."""
    return funnels.funnel(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_type", ["view", "click", "purchase"], 12 * 3600, "event_id")


@query(
    "rolled_uniques",
    """SELECT 'day' AS grain, CAST(ts AS DATE) AS start, event_type, count(DISTINCT user_id) AS uniques FROM events GROUP BY 2, 3 UNION ALL
    SELECT 'week', CAST(date_trunc('week', ts) AS DATE), event_type, count(DISTINCT user_id) FROM events GROUP BY 2, 3 UNION ALL
    SELECT 'month', CAST(date_trunc('month', ts) AS DATE), event_type, count(DISTINCT user_id) FROM events GROUP BY 2, 3 UNION ALL SELECT 'month of all types', CAST(date_trunc('month', ts) AS DATE), NULL, count(DISTINCT user_id) FROM events GROUP BY 2""",
)
def rolled_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a day and type as bitmaps; weeks and months from the table of days, months of all types from months. The events are read once."""
    at = fresh(spark, "daily-users")
    distinct.bitmaps(table(spark, sf_dir, "events"), [F.to_date("ts").alias("start"), "event_type"], "user_id").write.parquet(at)
    days = spark.read.parquet(at)
    weeks, months = (distinct.rolled_up(days, [F.to_date(F.date_trunc(g, "start")).alias("start"), "event_type"]) for g in ("week", "month"))
    whole = distinct.rolled_up(months, ["start"]).withColumn("event_type", F.lit(None).cast("string"))
    out = [distinct.counted(d, ["start", "event_type"]).withColumn("grain", F.lit(g)) for g, d in (("day", days), ("week", weeks), ("month", months), ("month of all types", whole))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    "heavy_hitters",
    """WITH w AS (SELECT unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS value FROM documents)
    SELECT value, count(*) AS n FROM w WHERE value <> '' GROUP BY value HAVING count(*) > 0.004 * (SELECT count(*) FROM w WHERE value <> '')""",
)
def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are more than four in a thousand of all words of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    return distinct.frequent(words, "word", 0.004)[0]


@query(
    "gap_filling",
    """WITH p AS (SELECT user_id, CAST(ts AS DATE) - DATE '1970-01-01' AS slot, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT user_id, min(slot) AS a, max(slot) AS b FROM p GROUP BY 1),
    g AS (SELECT user_id, unnest(generate_series(a, b)) AS slot FROM r),
    j AS (SELECT g.user_id, g.slot, v, last_value(v IGNORE NULLS) OVER w AS l, last_value(CASE WHEN v IS NOT NULL THEN g.slot END IGNORE NULLS) OVER w AS ls, first_value(v IGNORE NULLS) OVER x AS n, first_value(CASE WHEN v IS NOT NULL THEN g.slot END IGNORE NULLS) OVER x AS ns
      FROM g LEFT JOIN p ON p.user_id = g.user_id AND p.slot = g.slot WINDOW w AS (PARTITION BY g.user_id ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY g.user_id ORDER BY g.slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, slot, round(v, 6) AS value, round(l, 6) AS last, round(n, 6) AS next, round(CASE WHEN ns = ls THEN l ELSE l + (n - l) * (slot - ls) / (ns - ls) END, 6) AS linear FROM j""",
)
def gap_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's mean value of every day from the first to the last, days without events filled in three ways."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("slot")).agg(F.avg("value").alias("value"))
    got = gaps.filled(days, ["user_id"], "slot", "value")
    return got.select("user_id", "slot", *(F.round(c, 6).alias(c) for c in ("value", "last", "next", "linear")))


@query(
    "asof_sliced",
    """SELECT p.event_id, e.event_id AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') e ON p.user_id = e.user_id AND p.ts >= e.ts""",
)
def asof_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click before each purchase, a user's history in slices of a week."""
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("ct"), F.col("event_id").alias("click_id"))
    return temporal.asof_join(bought, clicks, ["user_id"], "ts", "ct", ["click_id"], 7 * 86_400).select("event_id", "click_id")


#: Lines of a bucket, which a task sorts at once. Files are compressed, their bytes say little of it.
BUCKET_ROWS = 1 << 20


def laid_out(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """`df` as a table in buckets of `key`, each in its order: joins and aggregates on the key need no exchange."""
    name = f"laid_out_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", fresh(df.sparkSession, "buckets")).saveAsTable(name)
    return df.sparkSession.table(name)


@query("bucketed_join", "SELECT o_orderkey, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines, both laid out by order: neither the join nor the aggregate on top of it moves a row."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    buckets = max(8, -(-lines.count() // BUCKET_ROWS))
    o = laid_out(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", buckets)
    joined = o.hint("merge").join(laid_out(lines, "l_orderkey", buckets), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "pruned_partitions",
    "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS held FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1, 2",
)
def pruned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a folder for each nation; which folders are read is known from the filtered nations at run time."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    at = fresh(spark, "customers")
    formats.write(c.repartition("c_nationkey"), at, "parquet", ["c_nationkey"])
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    met = formats.read(spark, at, "parquet", c.schema).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at any size
    return met.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("held"))


def _journal(spark: SparkSession, rows: DataFrame, parts: list[str]) -> str:
    """A journal with a commit for each filter."""
    spark.dataSource.register(journal.JournalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    at = fresh(spark, "journal")
    for test in parts:
        rows.where(test).write.format("journal").option("path", at).mode("append").save()
    return at


@query(
    "journal_source",
    "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('view', 'purchase') GROUP BY event_type",
)
def journal_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as three commits by a Python sink and read back by a Python reader that gets the filters."""
    at = _journal(spark, table(spark, sf_dir, "events"), [f"pmod(event_id, 3) = {k}" for k in range(3)])
    some = spark.read.format("journal").option("path", at).load().where("ts >= timestamp_ntz'2024-01-10 00:00:00' and ts < timestamp_ntz'2024-01-20 00:00:00' and event_type in ('view', 'purchase')")
    return some.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first"))


@query("journal_stream", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases streamed from one journal to another, in two runs: the second goes on at the first one's offset."""
    e = table(spark, sf_dir, "events")
    half = "event_id < 500"
    at, out, state = _journal(spark, e, [half]), fresh(spark, "journal"), fresh(spark, "journal-state")

    def run() -> None:
        bought = spark.readStream.format("journal").option("path", at).load().where("event_type = 'purchase'").select("event_id", "user_id", "value")
        q = bought.writeStream.format("journal").option("path", out).option("query", "purchases").option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        q.awaitTermination()

    run()
    e.where(f"not ({half})").write.format("journal").option("path", at).mode("append").save()
    run()
    return spark.read.format("journal").option("path", out).schema("event_id long, user_id long, value double").load()
