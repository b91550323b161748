"""Operators apart from their queries: skew, plans, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import skew, temporal
from tidemill.plans.registry import table
from tidemill.sources import formats

DATA = "/root/testdata/sf0.001"


def test_salted_join_is_the_join(spark):
    left = spark.createDataFrame([(1, "x")] * 500 + [(k, f"y{k}") for k in range(2, 200)] + [(None, "n")], "k long, v string")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (None, "z")], "k long, w string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
        assert sorted(map(tuple, skew.salted_join(left, right, "k", 4, how).collect()), key=repr) == want
    assert [r.k for r in skew.hot_keys(left, "k").collect()] == [1]


def test_filters_reach_the_scan(spark, tmp_path):
    plan = table(spark, DATA, "lineitem").where("l_quantity > 49").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    orders = table(spark, DATA, "orders").select("o_orderkey", "o_orderstatus")
    formats.write(orders, f"file://{tmp_path}/o", "parquet", ["o_orderstatus"])
    kept = formats.read(spark, f"file://{tmp_path}/o", "parquet", orders.schema).where("o_orderstatus = 'F'")
    assert "PartitionFilters: [isnotnull(o_orderstatus" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == orders.where("o_orderstatus = 'F'").count()


def test_sessions_at_one_time(spark):
    rows = [(1, 0, "a"), (1, 0, "b"), (1, 100, "c"), (2, 0, "d")]
    df = spark.createDataFrame(rows, "u long, s long, x string").withColumn("t", F.timestamp_seconds("s"))
    got = {r.x: r.session for r in temporal.sessions(df, ["u"], "t", 60).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "d": 0}
