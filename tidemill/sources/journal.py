"""A Python data source with a sink, a batch reader and a stream reader: a journal of commits.

A write is a commit. Tasks write Parquet files of their own; the driver then writes the commit's entry, which
lists them with their rows and with each column's least and greatest value, under a temporary name and moves it
to its number. Readers see what entries list, so a write that fails, or a task's attempt that is lost,
leaves nothing to be seen. The files of a write that fails are deleted: its end is marked first, so a task that
ends later deletes its own, and what a killed one has left goes with the next commit. A streaming batch that runs again finds its
entry and adds nothing.

    spark.dataSource.register(JournalSource)
    df.write.format("journal").option("path", at).mode("append").save()
    spark.read.format("journal").option("path", at).load()             # all commits
    spark.readStream.format("journal").option("path", at).load()       # a batch for the commits that are new
    stream.writeStream.format("journal").option("path", at)...

Filters reach the reader (spark.sql.python.filterPushdown.enabled): comparisons with a constant skip files by their
least and greatest values, and are applied to the Arrow batches of the others. Load a journal anew for each query: Spark 4.1
keeps the files that it has planned with what load() gave, also for a later query without filters that it can push. Columns may be of any type
that Parquet has; those of strings, numbers, dates and times without a zone have bounds. Overwriting starts a new generation, and the
entries before it are no longer read.

The path is a local one or a URI that pyarrow's file systems read (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext, cloudpickle
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package

ROWS = 1 << 16
Bounds = dict[str, tuple]


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, at.rstrip("/")


def _plain(value: object) -> object:
    """A bound as JSON holds it; None for kinds without bounds."""
    if isinstance(value, datetime):
        return None if value.tzinfo is not None else ["time", value.isoformat()]
    if isinstance(value, date):
        return ["date", value.isoformat()]
    return ["value", value] if isinstance(value, (bool, int, str)) or isinstance(value, float) and value == value else None


def _value(plain: list) -> object:
    kind, v = plain
    return {"time": datetime.fromisoformat, "date": date.fromisoformat}.get(kind, lambda x: x)(v)


class Bound:
    """Least and greatest value of each column, over the batches that go by."""

    def __init__(self) -> None:
        self.rows, self.of, self.nulls = 0, {}, {}

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows += batch.num_rows
        for name, column in zip(batch.schema.names, batch.columns):
            self.nulls[name] = self.nulls.get(name, 0) + column.null_count
            if pa.types.is_nested(column.type) or column.null_count == len(column):
                continue
            if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
                self.of[name] = None
            if self.of.get(name, ()) is None:
                continue
            try:
                m = pc.min_max(column).as_py()
            except pa.ArrowNotImplementedError:
                self.of[name] = None
                continue
            lo, hi = self.of.get(name, (m["min"], m["max"]))
            self.of[name] = (min(lo, m["min"]), max(hi, m["max"]))

    def entry(self) -> dict:
        kept = {n: [_plain(x) for x in b] for n, b in self.of.items() if b is not None}
        return {"rows": self.rows, "bounds": {n: b for n, b in kept.items() if None not in b}, "empty": [n for n, k in self.nulls.items() if k == self.rows]}


@dataclass
class Written(WriterCommitMessage):
    file: str
    entry: dict


class _Tasks:
    """What both writers' tasks do."""

    def __init__(self, path: str) -> None:
        self.path, self.id = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _fs(self.path)
        name = f"data/{self.id}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        fs.create_dir(f"{at}/data", recursive=True)
        seen, out = Bound(), None
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or pq.ParquetWriter(f"{at}/{name}", batch.schema, filesystem=fs)
                    out.write_batch(batch)
                    seen.add(batch)
            if out is not None:
                out.close()
            if fs.get_file_info(f"{at}/log/.failed-{self.id}").type != pafs.FileType.NotFound:
                raise ValueError("the write that this task belongs to has failed")
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{at}/{name}")
            raise
        return Written(name if out is not None else "", seen.entry())

    def remove(self, messages: list) -> None:
        fs, at = _fs(self.path)
        for m in messages:
            if m is not None and m.file and fs.get_file_info(f"{at}/{m.file}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{at}/{m.file}")

    def fail(self) -> None:
        fs, at = _fs(self.path)
        fs.create_dir(f"{at}/log", recursive=True)
        fs.open_output_stream(f"{at}/log/.failed-{self.id}").close()
        sweep(self.path)


def sweep(path: str) -> None:
    """Deletes what writes that have failed have left."""
    fs, at = _fs(path)
    names = lambda folder: [f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{at}/{folder}", allow_not_found=True))]
    failed = {n.removeprefix(".failed-") for n in names("log") if n.startswith(".failed-")}
    for name in names("data") if failed else ():
        if name.split("-")[0] in failed:
            fs.delete_file(f"{at}/data/{name}")


def entries(path: str) -> list[dict]:
    """The commits that count, in order."""
    fs, at = _fs(path)
    if fs.get_file_info(f"{at}/log").type == pafs.FileType.NotFound:
        return []
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{at}/log")) if f.path.endswith(".json") and not f.base_name.startswith("."))
    got = [json.loads(fs.open_input_stream(n).read()) for n in names]
    first = max((k for k, e in enumerate(got) if e["overwrite"]), default=0)
    return got[first:]


def _enter(path: str, messages: list, overwrite: bool, batch: str | None = None) -> None:
    fs, at = _fs(path)
    fs.create_dir(f"{at}/log", recursive=True)
    known = entries(path)
    number = known[-1]["number"] + 1 if known else 0
    files = [{"file": m.file, **m.entry} for m in messages if m is not None and m.file]
    text = json.dumps({"number": number, "overwrite": overwrite, "batch": batch, "files": files})
    temp = f"{at}/log/.{number:012d}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(text.encode())
    fs.move(temp, f"{at}/log/{number:012d}.json")
    sweep(path)


class JournalWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.tasks, self.path, self.overwrite = _Tasks(path), path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.tasks.write(iterator)

    def commit(self, messages: list) -> None:
        _enter(self.path, messages, self.overwrite)

    def abort(self, messages: list) -> None:
        self.tasks.fail()


class JournalStreamWriter(DataSourceStreamArrowWriter):
    """A batch is an entry with the batch's name: `query` and number."""

    def __init__(self, path: str, query: str) -> None:
        self.tasks, self.path, self.query = _Tasks(path), path, query

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.tasks.write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        name = f"{self.query}-{batchId}"
        if any(e["batch"] == name for e in entries(self.path)):
            self.tasks.remove(messages)  # a run before this one has got so far
        else:
            _enter(self.path, messages, False, name)

    def abort(self, messages: list, batchId: int) -> None:
        self.tasks.remove(messages)  # its writer may be that of later batches


#: What a filter with a constant says of a file's least and greatest value, and of its rows.
_TESTS = {
    EqualTo: (lambda lo, hi, v: lo <= v <= hi, pc.equal), GreaterThan: (lambda lo, hi, v: hi > v, pc.greater), GreaterThanOrEqual: (lambda lo, hi, v: hi >= v, pc.greater_equal),
    LessThan: (lambda lo, hi, v: lo < v, pc.less), LessThanOrEqual: (lambda lo, hi, v: lo <= v, pc.less_equal), In: (lambda lo, hi, v: any(lo <= x <= hi for x in v), None),
}


@dataclass
class Test:
    kind: type
    column: str
    value: object

    def may_hold(self, file: dict) -> bool:
        if self.column in file["empty"]:
            return False  # no comparison holds of null
        if self.kind is IsNotNull or self.column not in file["bounds"]:
            return True
        lo, hi = map(_value, file["bounds"][self.column])
        return _TESTS[self.kind][0](lo, hi, self.value)

    def holds(self, batch: pa.RecordBatch) -> pa.Array:
        column = batch.column(self.column)
        if self.kind is IsNotNull:
            return column.is_valid()
        if self.kind is In:
            return pc.is_in(column, pa.array(self.value, column.type))
        return _TESTS[self.kind][1](column, pa.scalar(self.value, column.type))


@dataclass
class FilePart(InputPartition):
    file: str


class _Files:
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, to_arrow_schema(schema)
        self.tests: list[Test] = []

    def read_part(self, part: FilePart | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for where there are no partitions
            return
        fs, at = _fs(self.path)
        for batch in pq.ParquetFile(f"{at}/{part.file}", filesystem=fs).iter_batches(ROWS, columns=self.schema.names):
            batch = pa.RecordBatch.from_arrays([batch.column(n).cast(self.schema.field(n).type) for n in self.schema.names], schema=self.schema)
            for t in self.tests:
                batch = batch.filter(pc.fill_null(t.holds(batch), False))
            if batch.num_rows:
                yield batch


class JournalReader(DataSourceReader, _Files):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of a column with a constant; gives the others back to Spark."""
        plain = {f.name for f in self.schema if not pa.types.is_nested(f.type) and getattr(f.type, "tz", None) is None and not pa.types.is_decimal(f.type) and not pa.types.is_floating(f.type)}
        for f in filters:
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in plain and (type(f) in _TESTS or type(f) is IsNotNull) and not (type(f) is In and None in f.value):
                self.tests.append(Test(type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        files = [f for e in entries(self.path) for f in e["files"]]
        return [FilePart(f["file"]) for f in files if all(t.may_hold(f) for t in self.tests)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return self.read_part(partition)


class JournalStreamReader(DataSourceStreamReader, _Files):
    """An offset is the number of the next entry."""

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        known = entries(self.path)
        return {"next": known[-1]["number"] + 1 if known else 0}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        return [FilePart(f["file"]) for e in entries(self.path) if start["next"] <= e["number"] < end["next"] for f in e["files"]]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        return self.read_part(partition)

    def commit(self, end: dict) -> None:
        pass  # entries stay for other readers

    def stop(self) -> None:
        pass


class JournalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "journal"

    @property
    def path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a journal needs a path")
        return self.options["path"]

    def schema(self) -> StructType:
        """That of the first file, as Spark's types; a journal without files needs a schema from the reader."""
        from pyspark.sql.pandas.types import from_arrow_schema

        for e in entries(self.path):
            for f in e["files"]:
                fs, at = _fs(self.path)
                return from_arrow_schema(pq.read_schema(f"{at}/{f['file']}", filesystem=fs), prefer_timestamp_ntz=True)
        raise ValueError("this journal is empty: give a schema")

    def reader(self, schema: StructType) -> JournalReader:
        return JournalReader(self.path, schema)

    def streamReader(self, schema: StructType) -> JournalStreamReader:
        return JournalStreamReader(self.path, schema)

    def writer(self, schema: StructType, overwrite: bool) -> JournalWriter:
        return JournalWriter(self.path, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> JournalStreamWriter:
        return JournalStreamWriter(self.path, self.options.get("query", "stream"))
