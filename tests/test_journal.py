"""The journal source: commits, aborts, pushed filters, offsets."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from tidemill.plans.registry import table
from tidemill.sources import journal

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def at(spark, tmp_path):
    spark.dataSource.register(journal.JournalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield f"file://{tmp_path}/j"
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def files(at):
    top = at.removeprefix("file://") + "/data"
    return sorted(os.listdir(top)) if os.path.isdir(top) else []


def put(df, at, mode="append"):
    df.write.format("journal").option("path", at).mode(mode).save()


def test_round_trip_append_and_overwrite(spark, at):
    e = table(spark, DATA, "events")
    put(e.where("event_id < 400").repartition(3), at)
    put(e.where("event_id >= 400").repartition(2), at)
    back = spark.read.format("journal").option("path", at).load()
    assert back.schema == e.schema
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    assert [len(x["files"]) for x in journal.entries(at)] == [3, 2]
    put(e.limit(7), at, "overwrite")
    assert spark.read.format("journal").option("path", at).load().count() == 7
    put(e.limit(0), at)
    assert spark.read.format("journal").option("path", at).load().count() == 7


def test_filters_reach_the_reader(spark, at):
    e = table(spark, DATA, "events")
    for k in range(5):
        put(e.where(f"event_id div 200 = {k}").coalesce(1), at)
    load = lambda at=at: spark.read.format("journal").option("path", at).load()
    some = load().where("event_id between 450 and 460 and event_type in ('view', 'click') and value > 0 and ts >= timestamp_ntz'2024-01-02 00:00:00'")
    assert some.rdd.getNumPartitions() == 1  # four files of five are never opened
    want = e.where("event_id between 450 and 460 and event_type in ('view', 'click') and value > 0 and ts >= timestamp_ntz'2024-01-02 00:00:00'")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, want.collect())) != []
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan or "event_id" not in plan.split("Filter (")[1].split("\n")[0]  # what the reader has taken isn't done again
    assert load().where("event_id > 5000").count() == 0
    assert load().where("event_type = 'nothing' or event_id = 3").count() == 1  # not a filter that it takes
    nulls = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "a int, b string")
    put(nulls, at + "-nulls")
    for test, n in (("b > ''", 2), ("a is not null", 2), ("a is null", 1), ("b not in ('x')", 1), ("b <=> null", 1), ("b in ('x', 'z')", 1), ("a >= 2 and b <= 'x'", 1)):
        assert load(at + "-nulls").where(test).count() == n


def test_a_failed_write_leaves_nothing(spark, at):
    e = table(spark, DATA, "events").repartition(3)
    put(e, at)
    before, n = files(at), len(journal.entries(at))
    bad = e.withColumn("user_id", F.when(F.col("event_id") == 777, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("user_id")))
    with pytest.raises(Exception, match="no"):
        put(bad, at)
    assert len(journal.entries(at)) == n
    for _ in range(20):  # tasks that the failure has caught at work
        journal.sweep(at)
        if files(at) == before:
            break
        time.sleep(1)
    assert files(at) == before
    w = journal.JournalWriter(at, False)
    left = at.removeprefix("file://") + f"/data/{w.tasks.id}-00000-x.parquet"
    open(left, "w").close()
    w.abort([None])
    assert files(at) == before and spark.read.format("journal").option("path", at).load().count() == e.count()


def test_stream_offsets_go_on_where_they_stopped(spark, at):
    e = table(spark, DATA, "events")
    out = at + "-out"
    put(e.where("event_id < 100"), at)

    def run():
        s = spark.readStream.format("journal").option("path", at).load().where("event_type = 'view'")
        q = s.writeStream.format("journal").option("path", out).option("query", "views").option("checkpointLocation", at + "-checkpoint").start()
        q.processAllAvailable()
        q.stop()

    run()
    first = [x["batch"] for x in journal.entries(out)]
    put(e.where("event_id between 100 and 199"), at)
    put(e.where("event_id between 200 and 299"), at)
    run()
    run()
    back = spark.read.format("journal").option("path", out).load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.where("event_id < 300 and event_type = 'view'").collect()))
    names = [x["batch"] for x in journal.entries(out)]
    assert len(first) == 1 and names[: len(first)] == first and len(set(names)) == len(names) == 2
    w = journal.JournalStreamWriter(out, "views")
    w.commit([None], 0)  # a batch that runs again
    assert [x["batch"] for x in journal.entries(out)] == names
