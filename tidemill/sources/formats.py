"""Files in the formats that Spark reads and writes itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

OPTIONS = {"csv": {"header": "true"}, "json": {}, "orc": {}, "parquet": {}, "text": {}, "xml": {"rowTag": "row"}}


def read(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """A table with a stated schema: no inference pass over the data."""
    return spark.read.format(kind).options(**OPTIONS[kind]).schema(schema).load(path)


def write(df: DataFrame, path: str, kind: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """`df` as files, partitioned `by` columns so that filters on them prune folders."""
    out = df.write.format(kind).options(**OPTIONS[kind]).mode(mode)
    (out.partitionBy(*by) if by else out).save(path)
