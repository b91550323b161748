"""What every operator of this subpackage needs from the cluster: code on the
executors, a shared folder for cut lineage, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "_tidemill_shipped"
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 4 << 20
HEAP = 8 << 20
#: Row groups of 16 MB, and sizes looked at from the first row on: else the writer holds 100 blobs of any size at least, as one page that it compresses at once.
_FILES = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays of 1 MB and more are mapped, and go back to the system when freed
        libc.mallopt(-1, HEAP)  # smaller ones come from a heap that isn't cut and grown again with each of them
        libc.mallopt(-8, 2)  # few arenas
        return libc
    except (OSError, AttributeError):  # not glibc: memory is kept as the allocator likes
        return None


_LIBC = _libc()


def relieve() -> None:
    """Gives freed memory back to the system: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors through the driver's file server, once a session.

    Unless the session has a limit of its own, Python workers get about BATCH bytes at a time from now on, not 10,000 rows of up to 64 MB: the JVM
    holds a batch outside its heap, in a buffer that doubles, for each task and each Python function in it."""
    if spark.conf.get(_BATCHES, None) is None:
        spark.conf.set(_BATCHES, str(BATCH))
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(), "tidemill_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(to)
    setattr(sc, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. One of our own only on a local master
    where it is unset (tests on one machine); on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        sc.setCheckpointDir(base)
    elif "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base) if sc.master.startswith("local") else base
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder among this application's, which go when it ends."""
    own = f"{shared_dir(spark)}/tidemill-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind once it has succeeded."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """`df` as a table in the shared folder: the lineage ends here and survives lost executors. `options` are the writer's."""
    spark = df.sparkSession
    at = fresh_dir(spark, label)
    with _shuffles_go(spark):
        df.write.options(**_FILES, **options).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._tidemill_at = at
    if _open():
        _open()[-1].append(out)
    return out


_LOCAL = threading.local()


def _open() -> list[list[DataFrame]]:
    """This thread's: queries that are built at the same time keep to their own tables."""
    if not hasattr(_LOCAL, "open"):
        _LOCAL.open = []
    return _LOCAL.open


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are `written` inside go at the end, but for those given to what this yields: on those the result rests."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open().append([])
    try:
        yield keep
    finally:
        made = _open().pop()
        stay = {df._tidemill_at for df in kept}
        drop(*(df for df in made if df._tidemill_at not in stay))
        if _open():
            _open()[-1].extend(df for df in made if df._tidemill_at in stay)


def drop(*tables: DataFrame | None) -> None:
    """Deletes what `written` has given, once nothing reads it any more."""
    for df in tables:
        if df is not None and hasattr(df, "_tidemill_at"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidemill_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """About how many bytes `df` has: the optimizer's estimate from file sizes (no job
    runs), or 4 KB a row where it has none, as for rows that the driver sends."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else df.count() * 4096


def cell_count(spark: SparkSession, n_bytes: int, per_cell: int = 8 << 20) -> int:
    """How many hash cells to deal postings into: grows with the input, so a cell stays small.

    At 2**18 cells it ends: a cell of a 100 TB input then has a few hundred MB, and a
    task's message to a cell still holds dozens of postings.
    """
    return min(1 << 18, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // per_cell, 8))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.repartition(n, F.col(key))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` whose `column` has about `limit` bytes; one row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    yield batch.slice(start)


def apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with its columns named like `names` out of the way, and what gives a result its columns back."""
    taken = {n.lower() for n in names}
    own = [f"_own_{k}" if c.lower() in taken else c for k, c in enumerate(docs.columns)]
    return docs.toDF(*own), lambda out: out.select(*own).toDF(*docs.columns)
