"""Replays: a table's events as they might have arrived, and a stream's whole result as a table.

`arrivals` deals a table to slices of time, in which single events come one or more slices late (an SQL expression says how many), and
closes it with an event of each type far ahead of all others, so that the watermark passes them.
`replayed` runs a streaming result over what its sources have, a batch a slice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.sources.shared import delete, fresh, input_bytes
from tidemill.streaming.events import stream

SLICES, SLICE_BYTES, AHEAD_DAYS = 5, 128 << 20, 400
#: An event in seven comes a slice late.
SOME_LATE = "int(7919 * event_id % 7 = 3)"


@dataclass
class Arrivals:
    path: str
    files: int  # of a slice


def slice_of(events: DataFrame, slices: int, behind: str) -> DataFrame:
    """`events` with `slice`, 0 to slices - 1: the part of the whole time that an event is in, and `behind` more."""
    lo, hi = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(lo or 0)) * slices / F.lit((hi or 0) - (lo or 0) + 1))
    return events.withColumn("slice", F.least(F.lit(slices - 1), part + F.expr(behind)).cast("int"))


def arrivals(events: DataFrame, closing: list[str], slices: int = SLICES, behind: str = SOME_LATE) -> Arrivals:
    """Writes `events` (event_id, ts, user_id, event_type, ...) slice after slice, in files of about SLICE_BYTES, then the closing events:
    one of each type in `closing`, of users -1, -2, ..., AHEAD_DAYS after the last. A slice is a job, so files are in order of time."""
    spark = events.sparkSession
    dealt = slice_of(events, slices, behind)
    at, files = fresh(spark, "arrivals"), max(1, input_bytes(events) // (slices * SLICE_BYTES))
    end = (events.agg(F.max("ts").alias("ts")).select((F.coalesce("ts", F.lit("2000-01-01").cast(events.schema["ts"].dataType)) + F.expr(f"interval {AHEAD_DAYS} days")).alias("ts"))).cache()
    last = end.select("ts", F.posexplode(F.array(*map(F.lit, closing))).alias("k", "event_type"))
    known = {"event_id": -1 - F.col("k"), "user_id": -1 - F.col("k"), "ts": F.col("ts"), "event_type": F.col("event_type")}
    last = last.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))
    for k in range(slices):
        dealt.where(F.col("slice") == k).drop("slice").repartition(files).write.parquet(f"{at}/slice-{k:05d}")
    last.coalesce(1).write.parquet(f"{at}/slice-{slices:05d}")
    end.unpersist()
    return Arrivals(at, files)


def as_stream(spark: SparkSession, got: Arrivals) -> DataFrame:
    """A batch for each slice, in their order."""
    return stream(spark, f"{got.path}/*", got.files)


@dataclass
class Replay:
    table: DataFrame
    progress: list = field(default_factory=list)  # of each batch

    def dropped(self) -> int:
        """Rows that came too late, as the stateful operators count them (an aggregate's are summed up within a task before)."""
        return sum(s["numRowsDroppedByWatermark"] for p in self.progress for s in p["stateOperators"])


def replay(result: DataFrame, mode: str = "append", idle: bool = True) -> Replay:
    """Runs a streaming result over what its sources have now: all rows in append mode, the last batch's in complete
    mode, and in update mode all that were sent, with `batch`, the number of the batch.

    Each batch's rows have a folder of their own, written anew if the batch runs again, so none is doubled;
    in complete mode the one before goes. Nothing of it passes through the driver. Without `idle` batches, which let the last
    watermark evict state, a stream in processing time ends too: it would have a next one for ever."""
    spark = result.sparkSession
    at = fresh(spark, "replay")
    spark.createDataFrame([], result.schema).write.parquet(f"{at}/table/batch=-1")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/table/batch={batch}")
        if mode == "complete" and batch:
            delete(spark, f"{at}/table/batch={batch - 1}")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    set_to = {"spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower(), "spark.sql.shuffle.partitions": str(min(partitions, max(8, 2 * spark.sparkContext.defaultParallelism)))}
    was = {c: spark.conf.get(c) for c in set_to}
    for c, v in set_to.items():  # every partition has a state store, which each batch commits
        spark.conf.set(c, v)
    run: StreamingQuery = result.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    for c, v in was.items():  # the stream has its own copy
        spark.conf.set(c, v)
    run.awaitTermination()
    got = spark.read.schema(StructType([*result.schema, StructField("batch", LongType())])).parquet(f"{at}/table")
    return Replay(got if mode == "update" else got.drop("batch"), list(run.recentProgress))


def replayed(result: DataFrame, mode: str = "append", idle: bool = True) -> DataFrame:
    return replay(result, mode, idle).table
