"""As-of and interval joins, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], slice_seconds: int | None = None) -> DataFrame:
    """Each row of `left` with `values` of the last row of `right` of the same key that isn't later; null if none.

    One shuffle by key: both sides in one table, and a window that carries the last right row along.
    Of right rows at the same time the one with the largest values counts. With `slice_seconds` a key's rows are parted by slices of time,
    each in order in its task, and rows that come before all right rows of their slice take the last one of an earlier slice, which a table of a row a slice
    carries over; without it a key's rows are in order in one task."""
    taken = F.struct(*(F.col(v) for v in values))
    r = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), taken.alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    row = F.struct("*")
    lrows = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(taken).schema[0].dataType).alias("_v"), row.alias("_row"))
    both, keys = r.unionByName(lrows), [*by]
    if slice_seconds:
        both, keys = both.withColumn("_slice", F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / slice_seconds)), [*by, "_slice"]
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    if slice_seconds:
        ends = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_end"))
        before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, F.last(F.col("_end._v"), ignorenulls=True).over(before).alias("_carried"))
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
        cond = same[0]
        for x in same[1:]:
            cond = cond & x
        last = last.where("_last is not null").select("_row", "_last").unionByName(last.where("_last is null").alias("a").join(carried.alias("b"), cond, "left").select("a._row", F.col("b._carried").alias("_last")))
    return last.select("_row.*", *(F.col("_last")[v].alias(v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, before: str, after: str, bucket_seconds: int) -> DataFrame:
    """Pairs of one key whose right time is within [left - before, left + after].

    Time buckets make it an equi-join: a left row goes to every bucket its interval touches, a
    right row to its own, so a key with a long history is spread over many tasks.
    """
    bucket = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / bucket_seconds)
    lo, hi = F.col(left_time) - F.expr(f"interval {before}"), F.col(left_time) + F.expr(f"interval {after}")
    a = left.withColumn("_b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    b = right.withColumn("_b", bucket(F.col(right_time)))
    return a.join(b, [*by, "_b"]).where((F.col(right_time) >= lo) & (F.col(right_time) <= hi)).drop("_b")


def sessions(events: DataFrame, by: list[str], time: str, gap_seconds: int) -> DataFrame:
    """`events` with `session`, a number that rises where `gap_seconds` or more have passed. Events at one time are in one session.

    A key's events are in order in one task: keys are meant to be users or devices, not what holds a third of all rows."""
    w = Window.partitionBy(*by).orderBy(time, *(c for c in events.columns if c not in (*by, time)))
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    new = F.coalesce((seconds - F.lag(seconds).over(w) >= gap_seconds).cast("long"), F.lit(0))
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
