"""Regular time grids from irregular rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(points: DataFrame, by: list[str], slot: str, value: str, slice_slots: int = 4096) -> DataFrame:
    """by, slot, value, last, next, linear: every slot from a key's first to its last, with the value there (null in a gap), the last one carried on,
    the next one carried back, and the straight line between the two.

    `points` has one row for each key and whole-numbered slot, value not null. Only these are put in order: each looks up the next one
    of its key and then makes the slots up to it, so a gap costs what it adds to the result. A key's order is parted into
    slices of `slice_slots`; the last point of a slice finds the next one in a table of a row a slice."""
    part = F.floor(F.col(slot) / slice_slots)
    rows = points.where(F.col(slot).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(slot).cast("long").alias("_s"), F.col(value).cast("double").alias("_v"), part.alias("_part"))
    here = Window.partitionBy(*by, "_part").orderBy("_s")
    nxt = rows.withColumn("_n", F.lead(F.struct("_s", "_v")).over(here))
    firsts = rows.groupBy(*by, "_part").agg(F.min(F.struct("_s", "_v")).alias("_f"))
    after = firsts.withColumn("_after", F.lead("_f").over(Window.partitionBy(*by).orderBy("_part"))).drop("_f")
    known = nxt.where("_n is not null").unionByName(nxt.where("_n is null").drop("_n").join(after, [*by, "_part"]).withColumnRenamed("_after", "_n"))
    gap = F.coalesce(F.col("_n._s") - F.col("_s"), F.lit(1))
    grid = known.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), gap - 1)))
    at = F.when(F.col("_k") == 0, F.col("_v"))
    return grid.select(
        *by, (F.col("_s") + F.col("_k")).alias(slot), at.alias(value), F.col("_v").alias("last"), F.coalesce(at, F.col("_n._v")).alias("next"),
        (F.col("_v") + F.coalesce((F.col("_n._v") - F.col("_v")) * F.col("_k") / gap, F.lit(0.0))).alias("linear"),
    )
