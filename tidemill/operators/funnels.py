"""Ordered patterns of events within a time limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def funnel(events: DataFrame, by: list[str], time: str, kind: str, steps: list[str], within_seconds: int, tie: str | None = None, slot_seconds: int | None = None) -> DataFrame:
    """by, level: how many of `steps` a key has taken in order, each after the one before (by time, then `tie`) and all within `within_seconds` of the first.

    State: for each step, the latest first event of a chain that has got there. An event of step k hands that of step k - 1
    on if it isn't too old; a later start is never worse, so one for each step is enough. Histories are parted by slots of
    time, twice the limit or more: a slot starts chains with its own events and sees the next slot's as far as the limit
    reaches, so no key's history is one array and the answer is the greatest of its slots'. Keys without a first step have level 0; events without a key, a time or
    a kind don't count."""
    slot = slot_seconds or max(2 * within_seconds, 86_400)
    if slot < within_seconds:
        raise ValueError("a slot must be as long as the limit")
    us = F.unix_micros(F.col(time).cast("timestamp"))
    span, limit = slot * 1_000_000, within_seconds * 1_000_000
    rows = events.where(F.col(kind).isNotNull() & us.isNotNull())
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    step = F.array_position(F.array(*map(F.lit, steps)), F.col(kind)).cast("int")
    rows = rows.select(*by, us.alias("_t"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), step.alias("_k"))
    own = F.floor(F.col("_t") / span)
    before = F.when((F.col("_t") - own * span <= limit) & (F.col("_k") > 1), F.array(own, own - 1)).otherwise(F.array(own))
    parts = rows.where("_k > 0").withColumn("_slot", F.explode(before)).withColumn("_own", F.floor(F.col("_t") / span) == F.col("_slot"))
    chains = parts.groupBy(*by, "_slot").agg(F.sort_array(F.collect_list(F.struct("_t", "_tie", "_k", "_own"))).alias("_events"))

    def after(starts: Column, e: Column) -> Column:
        """starts[k]: when the latest chain that has taken k + 1 steps began; null if none has."""
        def at(k: int) -> Column:
            came = starts[k - 1] if k else e["_t"]
            fits = (e["_k"] == k + 1) & (e["_own"] if k == 0 else came.isNotNull() & (e["_t"] - came <= limit))
            return F.when(fits, F.greatest(came, starts[k]) if k else came).otherwise(starts[k])

        return F.array(*(at(k) for k in range(len(steps))))

    none = F.array(*(F.lit(None).cast("long") for _ in steps))
    level = F.size(F.filter(F.aggregate("_events", none, after), lambda x: x.isNotNull()))
    got = chains.select(*by, level.alias("level")).groupBy(*by).agg(F.max("level").cast("long").alias("level"))
    return rows.select(*by).distinct().join(got, by, "left").select(*by, F.coalesce("level", F.lit(0).cast("long")).alias("level"))
