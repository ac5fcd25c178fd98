"""The set of tables an operator works on."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise import model

Build = Callable[[frozenset[str] | None], DataFrame]


class Store:
    """Named tables with the columns of :data:`tillwise.model.TABLES`.

    A table is a frame or a function that builds one for the wanted columns,
    so a source can leave out joins that only serve columns nobody reads.
    """

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame | Build],
        counts: Mapping[str, Callable[[], DataFrame]] | None = None,
    ):
        self.spark = spark
        self._tables = dict(tables)
        self._counts = dict(counts or {})

    def scan(self, name: str, *columns: str) -> DataFrame:
        table = self._tables[name]
        df = table if isinstance(table, DataFrame) else table(frozenset(columns) or None)
        return df.select(*columns) if columns else df

    def count(self, name: str) -> DataFrame:
        """One row, RecordCount: without building the table where its source knows a shorter way."""
        if name in self._counts:
            return self._counts[name]()
        table = self._tables[name]
        rows = table if isinstance(table, DataFrame) else self.scan(name, model.PRIMARY_KEYS[name][0])
        return rows.agg(F.count("*").alias("RecordCount"))

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def replacing(self, **tables: DataFrame | Build) -> Store:
        kept = {name: count for name, count in self._counts.items() if name not in tables}
        return Store(self.spark, {**self._tables, **tables}, kept)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """The store kept as Parquet tables below ``path``, read lazily."""

        def reader(name: str) -> Build:
            return lambda _wanted: spark.read.parquet(f"{path}/{name}")

        return cls(spark, {name: reader(name) for name in model.TABLES})

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Write every table as Parquet below ``path``."""
        for name in self._tables:
            self.scan(name).write.mode(mode).parquet(f"{path}/{name}")
