"""Sorting in and across slices, slice boundaries that wait for a change, and undoing round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset
from slicewright.plans.ordinals import dense_places, number_rows
from slicewright.plans.scan import Scan

#: What null sorts as, by type; it ties with the real value. Other types sort null first.
_NULLS = {"string": "", "int": -(2**31), "bigint": -(2**63), "float": float("-inf"), "double": float("-inf"), "boolean": None}


def sort_key(df: DataFrame, column: str) -> Column:
    """Null as the least (latest for dates and times), NaN as infinity."""
    kind, c = dict(df.dtypes)[column], F.col(f"`{column}`")
    if kind.startswith("struct"):
        raise TypeError(f"{column}: {kind} has no order")
    if kind in ("float", "double"):
        c = F.when(F.isnan(c), F.lit(float("inf")).cast(kind)).otherwise(c)
    if kind == "boolean":
        return F.coalesce(c.cast("int"), F.lit(-1))
    if kind == "date":
        return F.coalesce(c, F.lit("9999-12-31").cast("date"))
    if kind.startswith("timestamp"):
        return F.coalesce(c, F.lit("9999-12-31 23:59:59.999999").cast(kind))
    if kind.startswith("decimal"):
        return F.coalesce(c, F.lit("-" + "9" * 20).cast("decimal(38,0)").cast(kind) if kind.endswith(",0)") else c)
    return F.coalesce(c, F.lit(_NULLS[kind]).cast(kind)) if kind in _NULLS else c


def _order(df: DataFrame, columns: list[str], descending: bool) -> list[Column]:
    if not columns:
        raise ValueError("at least one column to sort by")
    ties = [F.col(c) for c in ("_chain_ix", "_slice", "_pos") if c in df.columns]
    return [sort_key(df, c).desc() if descending else sort_key(df, c).asc() for c in columns] + ties


def sort_within(df: DataFrame, columns: list[str], descending: bool = False) -> DataFrame:
    """Each slice by itself, stable in both directions; ``_pos`` is new. Ranges of slices and keys are sorted, as a slice may be too large for a task."""
    _order(df, columns, descending)  # what can't be sorted is refused by its own name
    names = [c if c in ("_chain_ix", "_slice", "_pos") else f"c{k}" for k, c in enumerate(df.columns)]  # any text may name a column, but not in a file
    plain, physical = df.toDF(*names), dict(zip(df.columns, names, strict=True))
    placed = dense_places(plain, *_order(plain, [physical[c] for c in columns], descending))
    kept = {p: c for p, c in zip(names, df.columns, strict=True) if c not in ("_pos", "_chain_ix")}
    return placed.select(*kept, "_pos").toDF(*kept.values(), "_pos")


def sort_chain(catalog: Catalog, name: str, source: str, columns: list[str], descending: bool = False, previous: str | None = None, length: int = -1) -> Dataset:
    """The links up to ``source`` as one dataset, each slice sorted; links that ``previous`` was made from are left out, and a hash label of all links stays."""
    chain = catalog.made_since(previous, source, length)
    return catalog.write(name, sort_within(Scan(catalog, chain).frame(), columns, descending), previous, chain.hashlabel, source=source)


def boundaries(total: int, slices: int) -> list[int]:
    """The first row of each slice when rows are dealt evenly, the first slices taking the rest."""
    each, rest = divmod(total, slices)
    out, at = [], 0
    for k in range(slices):
        out.append(at)
        at += each + (k < rest)
    return out


def _place(numbered: DataFrame, starts: list[int]) -> DataFrame:
    slice_ = F.lit(0)
    start = F.lit(starts[0])
    for k, at in enumerate(starts[1:], 1):
        slice_ = F.when(F.col("_ord") >= at, k).otherwise(slice_)
        start = F.when(F.col("_ord") >= at, at).otherwise(start)
    return numbered.withColumns({"_slice": slice_.cast("int"), "_pos": (F.col("_ord") - start).cast("long")})


def changes_at(numbered: DataFrame, trigger: str, wanted: list[int]) -> list[int]:
    """Each wanted boundary moved on to the next row whose trigger differs from the row before; to the end if there is none."""
    total = numbered.count()
    before = numbered.select((F.col("_ord") + 1).alias("_ord"), F.col(f"`{trigger}`").alias("__before"))
    change = numbered.join(before, "_ord").where(~F.col(f"`{trigger}`").eqNullSafe(F.col("__before"))).select("_ord")
    found = change.agg(*[F.min(F.when(F.col("_ord") >= w, F.col("_ord"))).alias(f"w{k}") for k, w in enumerate(wanted)]).first()  # a value per slice
    out = [0]
    for k in range(1, len(wanted)):
        at = wanted[k] if wanted[k] >= total else found[k]
        out.append(max(out[-1], total if at is None else at))
    return out


def sort_across(df: DataFrame, columns: list[str], slices: int, descending: bool = False, trigger: str | None = None) -> DataFrame:
    """All rows in one order, dealt to slices of equal size in that order; with ``trigger`` a boundary waits for the column to change."""
    numbered = number_rows(df, *_order(df, columns, descending))
    starts = boundaries(numbered.count(), slices)
    if trigger is not None:
        starts = changes_at(numbered, trigger, starts)
    return _place(numbered, starts).drop("_ord", "_chain_ix")


def unroundrobin(df: DataFrame, lines: list[int], trigger: str | None = None) -> DataFrame:
    """Rows so placed that slice after slice gives the old round-robin order; slices keep their sizes, or wait for the trigger to change."""
    numbered = number_rows(df, "_pos", "_slice")
    starts = [sum(lines[:k]) for k in range(len(lines))]
    if trigger is not None:
        starts = changes_at(numbered, trigger, starts)
    return _place(numbered, starts).drop("_ord")
