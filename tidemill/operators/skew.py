"""Joins whose hot keys are split over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Keys that hold more than `share` of the rows: 1 / share of them at most. No job runs until it is read."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return counts.where(F.col(key).isNotNull()).crossJoin(F.broadcast(total)).where(F.col("_n") > share * F.col("_all")).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner", share: float = 0.01) -> DataFrame:
    """`left` joined with `right` on `key`; the rows of left's hot keys, and its null keys, are dealt to `salts` tasks by a hash of the row, and only the
    hot keys' rows of `right` are repeated. A task that runs again deals alike, in whatever order its rows come; repeated rows go together.

    For keys that repeat in `left` and are few in `right`, where adaptive skew handling doesn't apply
    (an aggregate or window follows on the same key). Inner and left joins only.
    """
    if how not in ("inner", "left"):
        raise ValueError("salting repeats the right side: only inner and left joins keep their meaning")
    hot = hot_keys(left, key, share).withColumn("_hot", F.lit(True))
    pick = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", pick).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
