"""Interval-overlap join, by hierarchical bins where a key has many intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.shared import fresh

LEVELS = 62
#: Pairs of a key that are compared without bins.
PAIRS = 1 << 14


def level_of(length: Column, base: int) -> Column:
    """The least k with length <= base * 2**k: an interval touches two bins of its level at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2((length + 1) / F.lit(base)))).cast("int")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], base: int = 3600) -> DataFrame:
    """Pairs of one key whose closed intervals [start, end] meet, each once; ends are whole numbers (such as microseconds), columns of `left` and `right` differ but for `by`.

    Both sides are written once, as they are read several times. A key with PAIRS pairs at most has them compared in a plain join, in which
    every row is one row; keys with more go by bins, with the same result. Rows with a null key, a null end or an end before the start have no pairs."""

    def written(df: DataFrame, span: tuple[str, str], label: str) -> DataFrame:
        at = fresh(df.sparkSession, label)
        df.dropna(subset=by).where(F.col(span[0]) <= F.col(span[1])).write.parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    a, b = written(left, left_span, "overlap-left"), written(right, right_span, "overlap-right")
    ones = a.select(*by, F.lit(1).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b")).unionByName(b.select(*by, F.lit(0).cast("long").alias("_a"), F.lit(1).cast("long").alias("_b")))
    at = fresh(left.sparkSession, "overlap-keys")
    ones.groupBy(*by).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where(F.col("_a") > F.floor(F.lit(PAIRS) / F.greatest(F.col("_b"), F.lit(1)))).where("_b > 0").select(*by).write.parquet(at)
    many = left.sparkSession.read.schema(a.select(*by).schema).parquet(at)

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, by).where((F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])))

    if many.isEmpty():
        return met(a, b)
    few = met(a.join(many, by, "left_anti"), b.join(many, by, "left_anti"))
    return few.unionByName(_binned(a.join(many, by, "left_semi"), b.join(many, by, "left_semi"), by, left_span, right_span, base))


def _binned(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], base: int) -> DataFrame:
    """The pairs by bins.

    Every interval has a level by its length, bins of a level are base * 2**level wide, and a pair meets at the greater of its two
    levels: the longer one is there in its one or two bins, the shorter one in those that it touches. So an interval has at most two rows
    for each level of the other side at or above its own, however long others are, and a key's history is spread over
    its bins. Of the two bins that a pair can share, the one in which the overlap begins gives it. The levels that each side has are
    looked up first (LEVELS numbers at most)."""

    def levelled(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        return df.withColumn("_own", level_of(F.col(span[1]) - F.col(span[0]), base))

    def levels(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select("_own").distinct().collect())

    a, b = levelled(left, left_span), levelled(right, right_span)
    la, lb = levels(a), levels(b)

    def width(level: Column) -> Column:
        return F.lit(base).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), level)

    def binned(df: DataFrame, span: tuple[str, str], others: list[int]) -> DataFrame:
        """The row once for its own level and once for each higher one that the other side has, in each bin that it touches."""
        higher = F.filter(F.array(*map(F.lit, others)) if others else F.array().cast("array<int>"), lambda k: k > F.col("_own"))
        at = df.withColumn("_level", F.explode(F.concat(F.array(F.col("_own")), higher)))
        w = width(F.col("_level"))
        return at.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(span[0]) / w), F.floor(F.col(span[1]) / w)))).withColumn("_home", F.col("_level") == F.col("_own")).drop("_own")

    x, y = binned(a, left_span, lb), binned(b, right_span, la)
    both = x.join(y.withColumnRenamed("_home", "_home2"), [*by, "_level", "_bin"])
    s, e = F.greatest(F.col(left_span[0]), F.col(right_span[0])), F.least(F.col(left_span[1]), F.col(right_span[1]))
    owner = F.floor(s / width(F.col("_level"))) == F.col("_bin")
    return both.where((F.col("_home") | F.col("_home2")) & (s <= e) & owner).drop("_level", "_bin", "_home", "_home2")
