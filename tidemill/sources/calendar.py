"""A Python data source: the days of a span of years, a partition a year.

    spark.dataSource.register(CalendarSource)
    spark.read.format("calendar").option("first", 2024).option("last", 2026).load()
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Year(InputPartition):
    def __init__(self, year: int) -> None:
        self.year = year


class CalendarReader(DataSourceReader):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last

    def partitions(self) -> list[Year]:
        return [Year(y) for y in range(self.first, self.last + 1)]

    def read(self, partition: Year) -> Iterator[tuple]:
        day = date(partition.year, 1, 1)
        while day.year == partition.year:
            yield day, day.isocalendar().week, day.isoweekday() > 5
            day += timedelta(days=1)


class CalendarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "day date, week int, weekend boolean"

    def reader(self, schema: StructType) -> CalendarReader:
        return CalendarReader(int(self.options.get("first", 2024)), int(self.options.get("last", 2024)))
