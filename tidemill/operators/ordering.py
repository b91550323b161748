"""Order over a whole table without one task for it: row numbers, running totals, exact quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemill.sources.shared import fresh, input_bytes

PART_BYTES, SMALL = 128 << 20, 32 << 20


def ranged(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """`df` as a table of ranges of `order`, with `_part`, the number of the range. Written down: where the ranges
    begin comes from a sample, and all that is computed of them has to see the same ones, whatever executor is lost."""
    spark = df.sparkSession
    size = input_bytes(df)
    known = size // PART_BYTES if size < 1 << 55 else 0  # no estimate
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), known)
    at = fresh(spark, "ranged")
    df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).write.parquet(at)
    return spark.read.schema(StructType([*df.schema, StructField("_part", IntegerType())])).parquet(at)


def numbered(df: DataFrame, order: list[str], total_of: str | None = None, parts: int | None = None) -> DataFrame:
    """`df` with `row_number` by `order` (ascending, null first) over the whole table, from 1, and `running_total` of a column up to each row.

    Ranges are numbered each in its task; how many rows, and how much, the ranges before hold is a table of a
    row a range. `order` should tell rows apart: rows with equal values are one range's, in any order."""
    table = ranged(df, order, parts)
    value = F.coalesce(F.col(total_of), F.lit(0)) if total_of else F.lit(0)
    sums = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_s").over(before).alias("_s0"))  # a row a range
    w = Window.partitionBy("_part").orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = table.join(F.broadcast(starts), "_part").withColumn("row_number", F.col("_n0") + F.row_number().over(w))
    if total_of:
        out = out.withColumn("running_total", F.sum(value).over(up) + F.coalesce("_s0", F.lit(0).cast(dict(starts.dtypes)["_s0"])))
    return out.drop("_part", "_n0", "_s0")


def _written(df: DataFrame, label: str) -> DataFrame:
    at = fresh(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """`left` with the columns of `right`, a row a group; null keys are equal. Broadcast if its files are small."""
    r = right.toDF(*(f"_r_{c}" if c in keys else c for c in right.columns))
    same: Column = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys))
    return left.join(F.broadcast(r) if input_bytes(right) <= SMALL else r, same).drop(*(f"_r_{c}" for c in keys))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float], accuracy: int = 1000) -> DataFrame:
    """by, q, n, discrete, continuous: exact quantiles of each group's values that aren't null or NaN, as PERCENTILE_DISC and PERCENTILE_CONT give them.

    Selection in two passes: a mergeable sketch of each group brackets each rank by two values; the second pass counts what
    is below the bracket and, by value, what is inside, and only that is put in order, by ranges of the whole table (`numbered`).
    So no task gets a group's values, however many it has and however often one is repeated. Should a sketch have missed a rank,
    which the counts tell, brackets are the whole range."""
    name = {c: f"_by{k}" for k, c in enumerate(by)}
    keys = [*name.values()] or ["_by"]
    kept = df.select(*(F.col(c).alias(k) for c, k in name.items()), F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if dict(kept.dtypes)["_v"] in ("float", "double"):
        kept = kept.where(~F.isnan("_v"))
    if not by:
        kept = kept.withColumn("_by", F.lit(0))
    points = [k / accuracy for k in range(accuracy + 1)]
    groups = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", points, 4 * accuracy).alias("_grid"))
    asked = F.col("q") * (F.col("n") - 1)
    ranks = groups.withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumns({"_rank": 1 + F.floor(asked).cast("long"), "_part": asked - F.floor(asked), "_disc": F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long")})
    ranks = ranks.withColumn("_next", F.least(F.col("n"), F.col("_rank") + 1))
    first, last = F.least("_rank", "_disc"), F.greatest("_next", "_disc")
    place = lambda r, d: F.greatest(F.lit(1), F.least(F.lit(accuracy + 1), F.floor((r / F.col("n") + d) * accuracy) + 1)).cast("int")
    for margin in (2 / accuracy, 2.0):
        bounds = ranks.select("*", F.element_at("_grid", place(first, -margin)).alias("_lo"), F.element_at("_grid", place(last, margin)).alias("_hi"))
        bounds = _written(bounds.drop("_grid"), "quantile-bounds")
        hit = _met(kept, bounds.select(*keys, "q", "_lo", "_hi"), keys).where("_v <= _hi")
        counts = _written(hit.groupBy(*keys, "q", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "quantile-counts")
        sums = counts.groupBy(*keys, "q").agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_below"), F.sum("_c").alias("_to"))
        known = _written(_met(sums, bounds, [*keys, "q"]), "quantile-ranks")
        if known.where((F.col("_below") >= first) | (F.col("_to") < last)).isEmpty():
            break
    inside = numbered(counts.where("_v is not null"), [*keys, "q", "_v"], "_c")
    starts = inside.groupBy(*keys, "q").agg(F.min(F.col("running_total") - F.col("_c")).alias("_start"))
    up_to = _met(inside.drop("row_number"), _written(_met(known, starts, [*keys, "q"]), "quantile-starts").drop("_lo", "_hi"), [*keys, "q"])
    end = F.col("_below") + F.col("running_total") - F.col("_start")
    least = lambda r: F.min(F.when(end >= F.col(r), F.col("_v")))
    got = up_to.groupBy(*keys, "q", "n", "_part").agg(least("_disc").alias("discrete"), least("_rank").alias("_a"), least("_next").alias("_b"))
    return got.select(*(F.col(k).alias(c) for c, k in name.items()), "q", "n", "discrete", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("continuous"))
