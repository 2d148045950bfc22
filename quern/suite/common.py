"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder as attributes, read on use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self._folder, name)


def register(queries: dict[str, Query], oracles: dict[str, str]):
    """A decorator query(sql) that takes a function of Tables and files it under its name."""

    def query(sql: str):
        def file(f: Callable[[Tables], DataFrame]):
            queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            oracles[f.__name__] = sql
            return f

        return file

    return query
