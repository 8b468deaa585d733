"""Operations beyond the model itself: joins, windows and grouping that Spark has and sliced datasets can use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return left.join(right.drop("_slice", "_pos"), key, how)


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """For each row on the left the latest value on the right at or before it; one shuffle of both sides by ``by``."""
    l = left.select(by, at, F.lit(1).alias("__side"), *[c for c in left.columns if c not in (by, at)])
    both = l.unionByName(right.select(by, at, F.col(value).alias("__value"), F.lit(0).alias("__side")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(order)).where("__side = 1").drop("__side", "__value")
