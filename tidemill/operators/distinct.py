"""Distinct counts that can be added up again, exact; values that are frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(df: DataFrame, by: list[str | Column], number: str) -> DataFrame:
    """by, _bucket, _bits: the different values of a whole-number column as bitmaps of 32,768 bits a bucket.

    The bitmaps are as mergeable as a sketch and exact; a group's buckets are rows of their own, so its size is spread out."""
    n = F.col(number).cast("long")
    return df.where(n.isNotNull()).groupBy(*by, F.bitmap_bucket_number(n).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_bits"))


def rolled_up(parts: DataFrame, by: list[str | Column]) -> DataFrame:
    """Bitmaps of coarser groups from those of finer ones, without the rows."""
    return parts.groupBy(*by, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))


def counted(parts: DataFrame, by: list[str], name: str = "uniques") -> DataFrame:
    return parts.groupBy(*by).agg(F.sum(F.bitmap_count("_bits")).alias(name))


def frequent(df: DataFrame, column: str, share: float, tracked: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(value, n) of every value with more than `share` of the rows, exact, and the sketch's (value, estimate) that led to it.

    Frequent-items sketches (a task's, merged) with `tracked` counters, 16 / share rounded up to a power of 2 if not stated, miss no value with more than
    3.5 / tracked of the rows and are off by so much at most; what they name, 1 / share values and few more, is then counted in a second pass, with
    a partial count in each task. Null isn't a value."""
    if not 0 < share < 1:
        raise ValueError("share is between 0 and 1")
    tracked = tracked or 1 << (int(16 / share) - 1).bit_length()
    if 3.5 / tracked >= share:
        raise ValueError("too few counters for this share")
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    sketch = rows.agg(F.expr(f"approx_top_k(value, {int(1 / (share - 3.5 / tracked)) + 1}, {tracked})").alias("top"))
    named = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("value"), F.col("t.count").alias("estimate"))
    total = rows.agg(F.count(F.lit(1)).alias("_rows"))  # one row
    exact = rows.join(F.broadcast(named.select("value")), "value", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return exact.crossJoin(F.broadcast(total)).where(F.col("n") > share * F.col("_rows")).select("value", "n"), named
