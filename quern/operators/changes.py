"""Data changes as DataFrame transforms: what a table holds after an upsert, update or delete."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _condition(where: Column | str | None) -> Column:
    if where is None:
        return F.lit(True)
    return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))


def update(table: DataFrame, changes: Mapping[str, Column | str], where: Column | str | None = None) -> DataFrame:
    """Columns set where the condition holds; every right side sees the old row."""
    hit = _condition(where)
    return table.select(
        *[F.when(hit, F.expr(v) if isinstance(v, str) else v).otherwise(F.col(f"`{c}`")).cast(table.schema[c].dataType).alias(c) if (v := changes.get(c)) is not None else F.col(f"`{c}`") for c in table.columns]
    )


def delete(table: DataFrame, where: Column | str | None = None) -> DataFrame:
    """Rows for which the condition isn't true."""
    return table.filter(~_condition(where))


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows that share a key, the last by order."""
    last = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return last.filter(F.col("__nth") == 1).drop("__nth")


def upsert(table: DataFrame, rows: DataFrame, key: str | None = None) -> DataFrame:
    """rows added to table, replacing those of the same key (the first column unless named); null keys are equal."""
    key = key or table.columns[0]
    old, new = table.alias("o"), rows.select(F.col(f"`{key}`").alias("__key")).distinct().alias("n")
    return old.join(new, F.col(f"o.`{key}`").eqNullSafe(F.col("n.__key")), "left_anti").unionByName(rows)
