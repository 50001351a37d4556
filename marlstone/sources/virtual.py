"""Virtual tables: Python data sources that make rows when they are read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows that one task makes.
PART_ROWS = 1_000_000


class Series(DataSource):
    """value from start to stop, both included, by step."""

    @classmethod
    def name(cls) -> str:
        return "marlstone_series"

    def schema(self) -> str:
        return "value bigint"

    def reader(self, schema) -> DataSourceReader:
        return _SeriesReader(int(self.options["start"]), int(self.options["stop"]), int(self.options.get("step", "1")))


class _SeriesReader(DataSourceReader):
    def __init__(self, start: int, stop: int, step: int) -> None:
        self.start, self.step = start, step
        self.n = max(0, (stop - start) // step + 1) if step else 0

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((lo, min(lo + PART_ROWS, self.n))) for lo in range(0, max(self.n, 1), PART_ROWS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        lo, hi = partition.value
        for i in range(lo, hi):
            yield (self.start + i * self.step,)


def virtual_table(spark: SparkSession, source: type[DataSource], **options: object) -> DataFrame:
    """CREATE VIRTUAL TABLE ... USING source(options)."""
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load()


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """generate_series(start, stop, step) in FROM, both ends included: one column, value. Spark's own range makes it."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")
