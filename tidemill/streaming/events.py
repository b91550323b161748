"""Event streams: file source, watermarked windows, sessions, deduplication, stream-stream joins, state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The parquet files under `path` as a stream, oldest first, event time as a timestamp (a watermark needs one)."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path if not path.endswith(".parquet") else f"{path[:-1]}[{path[-1]}]")
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def counted(events: DataFrame, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Events by tumbling or sliding window and type. In append mode a window is given once it is older than `late` behind the
    newest event, and its state and all later events of it are dropped; in complete mode all state stays."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Each user's sessions: events with less than `gap` between them."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key; keys are remembered for `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def followed(first: DataFrame, second: DataFrame, within: str, late: str, how: str = "inner") -> DataFrame:
    """Pairs of an event of `first` and one of `second` of the same user that comes at most `within` later.

    With how = "leftOuter" an event of `first` that nothing follows is given too, with nulls, once the watermark
    has passed the last time at which something could: it is emitted as its state is evicted."""
    a = first.select("user_id", F.col("ts").alias("ta"), F.col("event_id").alias("first_id")).withWatermark("ta", late)
    b = second.select(F.col("user_id").alias("user_b"), F.col("ts").alias("tb"), F.col("event_id").alias("second_id")).withWatermark("tb", late)
    return a.join(b, (F.col("user_id") == F.col("user_b")) & (F.col("tb") >= F.col("ta")) & (F.col("tb") <= F.col("ta") + F.expr(f"interval {within}")), how)


def running_totals(events: DataFrame) -> DataFrame:
    """Each user's number of events and the largest value so far, kept as state from batch to batch."""

    def add(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, most = state.get if state.exists else (0, float("-inf"))
        for p in parts:
            n, most = n + len(p), max(most, float(p["value"].max()))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(add, "user_id long, n long, most double", "n long, most double", "update", GroupStateTimeout.NoTimeout)
