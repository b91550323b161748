from __future__ import annotations

import threading
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R


def test_threads_keep_to_their_own_tables(spark):
    """A scratch block that ends while another thread's is open drops nothing of that thread's."""
    opened, closed, got = threading.Event(), threading.Event(), []

    def other() -> None:
        with R.scratch():
            table = R.written(spark.range(5).toDF("x"), "other")
            opened.set()
            closed.wait(60)
            got.append(table.count())

    t = threading.Thread(target=other)
    with R.scratch() as keep:
        t.start()
        assert opened.wait(60)
        mine, gone = keep(R.written(spark.range(3).toDF("x"), "mine")), R.written(spark.range(2).toDF("x"), "gone")
    closed.set()
    t.join(60)
    assert got == [5] and mine.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(gone._tidemill_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_batches_are_bounded_in_bytes(spark):
    """Rows of long texts reach a Python function a few MB at a time, whatever their number; a limit of the session's own stays."""

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    docs = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    R.ship(spark)
    got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 300 * 100_000 and max(got) <= (4 << 20) + 200_000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    try:
        R.ship(spark)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 1_300_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_row_groups_of_large_blobs_are_bounded(spark):
    """A writer holds some 16 MB of blobs, not all that a task has."""
    blobs = spark.range(0, 60, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 16384), i -> sha2(cast(id * 16384 + i as string), 256)), '') as binary)").alias("data"))
    with R.scratch():
        out = R.written(blobs, "blobs")
        assert out.select(F.sum(F.length("data"))).first()[0] == 60 << 20
        for at in Path(out._tidemill_at.removeprefix("file://")).glob("*.parquet"):
            meta = pq.ParquetFile(at).metadata
            assert max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) <= 20 << 20
