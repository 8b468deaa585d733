"""Dense row numbers without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.session import materialize


def number_rows(df: DataFrame, *order: str | Column, name: str = "_ord") -> DataFrame:
    """``df`` with a dense number from 0 in the order given: ranges are sorted where they are, counted, and the counts added up."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    stored = materialize(ordered.withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = sorted(tuple(r) for r in stored.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before, values = 0, []
    for part, n in counts:
        values.append(f"({part}L, {before}L)")
        before += n
    offsets = F.broadcast(df.sparkSession.sql(f"select * from values {', '.join(values) or '(-1L, 0L)'} as t(__part, __before)"))
    return stored.join(offsets, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def dense_places(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with places dense from 0 in each slice, in the order given; no task sees a slice as a whole."""
    numbered = number_rows(rows, "_slice", *order, name="_n")
    starts = F.broadcast(numbered.groupBy("_slice").agg(F.min("_n").alias("_start")))  # a row per slice
    return numbered.join(starts, "_slice").withColumn("_pos", F.col("_n") - F.col("_start")).drop("_n", "_start", *[c for c in order if isinstance(c, str) and c != "_pos"])


def deal(df: DataFrame, slices: int, ordinal: str = "_ord") -> DataFrame:
    """Round robin: row n goes to slice n modulo ``slices``, at place n div ``slices``."""
    n = F.col(ordinal)
    return df.withColumns({"_slice": (n % slices).cast("int"), "_pos": F.floor(n / slices).cast("long")})
