"""Rows to slices by hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset
from slicewright.functions.hashing import md5_slice
from slicewright.plans.ordinals import dense_places
from slicewright.plans.scan import Scan


def hashpart(df: DataFrame, column: str, slices: int, how: Callable[[Column, int], Column] = md5_slice, spread_null: bool = False) -> DataFrame:
    """Each row in the slice of its value, in the order of old slice and place; null in slice 0, or in turn."""
    target = how(F.col(f"`{column}`"), slices)
    if spread_null:
        turn = F.row_number().over(Window.partitionBy("_slice", F.col(f"`{column}`").isNull()).orderBy("_pos"))
        target = F.when(F.col(f"`{column}`").isNull(), (turn + F.col("_slice") - 1) % slices).otherwise(target)
    old = [c for c in ("_chain_ix", "_slice", "_pos") if c in df.columns]
    placed = df.withColumn("__to", target.cast("int"))
    place = (F.row_number().over(Window.partitionBy("__to").orderBy(*old)) - 1).cast("long")
    return placed.withColumn("__at", place).drop(*old).withColumnsRenamed({"__to": "_slice", "__at": "_pos"})


def hashpart_chain(catalog: Catalog, name: str, source: str, hashlabel: str, previous: str | None = None, length: int = -1, as_chain: bool = False, how: Callable[[Column, int], Column] = md5_slice) -> Dataset:
    """The links up to ``source`` hashed on a column, in the order of link, old slice and place.

    Links that ``previous`` was made from are left out, ``length`` bounds their number. One dataset, or with ``as_chain`` a link for
    each old slice, ``name/0`` on, the last one called ``name``. A chain without links is an error.
    """
    rows = Scan(catalog, catalog.made_since(previous, source, length)).frame().withColumn("_old", F.col("_slice"))
    rows = rows.withColumn("_slice", how(F.col(f"`{hashlabel}`"), catalog.slices))
    order = ("_chain_ix", "_old", "_pos")
    if not as_chain:
        return catalog.write(name, dense_places(rows, *order), previous, hashlabel, source=source)
    for k in range(catalog.slices):
        own = name if k == catalog.slices - 1 else f"{name}/{k}"
        previous = catalog.write(own, dense_places(rows.where(F.col("_old") == k), *order), previous, hashlabel, source=source).id
    return catalog.get(previous)


def discard_wrong(df: DataFrame, column: str, slices: int, how: Callable[[Column, int], Column] = md5_slice) -> DataFrame:
    """Only the rows that are in the slice of their value."""
    return df.where(how(F.col(f"`{column}`"), slices) == F.col("_slice"))


def exact_slices(df: DataFrame, slices: int) -> DataFrame:
    """One physical partition for each slice, for work that goes slice by slice."""
    return df.repartitionById(slices, F.col("_slice")).sortWithinPartitions("_pos")
