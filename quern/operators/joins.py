"""Joins that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, slices: Column | None = None) -> DataFrame:
    """left with the columns of the latest row of right that agrees in `on` and isn't later; nulls where there is none.

    Both have the columns on and time; right's others follow left's, and of right's rows equal in
    on and time the largest counts. Keys are cut into slices of time (days unless given, an
    expression over the time column that rises with it): within a slice by a window, from slice to
    slice by one row each, so that a key that holds most rows is spread over as many tasks as it
    has slices. Null times match nothing.
    """
    slices = F.date_trunc("day", F.col(time)) if slices is None else slices
    given = [c for c in right.columns if c not in (*on, time)]
    key = [*on, "__slice"]
    rows = left.withColumns({"__slice": slices, "__row": F.struct(*[F.col(f"`{c}`") for c in left.columns])}).select(*key, F.col(time).alias("__time"), "__row", F.lit(None).cast(right.select(F.struct(*given)).schema[0].dataType).alias("__right"))
    events = right.filter(F.col(time).isNotNull()).withColumn("__slice", slices)
    events = events.select(*key, F.col(time).alias("__time"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct(*given).alias("__right"))
    both = rows.unionByName(events)
    ends = both.groupBy(*key).agg(F.max(F.when(F.col("__right").isNotNull(), F.struct("__time", "__right"))).alias("__end"))
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*on).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*key, before["__right"].alias("__carried"))
    # events of a time come before rows of that time, the largest last
    order = Window.partitionBy(*key).orderBy("__time", F.col("__right").isNull(), "__right").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__right", ignorenulls=True).over(order)).filter(F.col("__row").isNotNull())
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    out = seen.alias("a").join(carried.alias("b"), same, "left").select("__row", F.when(F.col("__row")[time].isNotNull(), F.coalesce("__seen", "__carried")).alias("__right"))
    return out.select("__row.*", *[F.col("__right")[c].alias(c) for c in given])
