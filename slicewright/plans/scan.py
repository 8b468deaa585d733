"""One description of a read over datasets, compiled to one DataFrame.

The order is fixed: links and slices are chosen from metadata, then translate, rehash, translate rows, range, filters, and the row slice last.
The range test sees untranslated values. Ranges follow SQL: null is in no range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset, DatasetError, SkipDataset, SkipSlice

#: Dictionaries up to this size become an expression; larger ones a joined table.
INLINE_DICT = 256


@dataclass
class Scan:
    """``slice_`` is a number, None for all in order, or "roundrobin"; ``translators`` are dicts or functions of a column; ``filters`` functions of a column, or None for truth."""

    catalog: Catalog
    links: list[Dataset]
    columns: list[str] | None = None
    slice_: int | str | None = None
    translators: dict[str, dict | Callable[[Column], Column]] = field(default_factory=dict)
    row_translator: Callable[[DataFrame], DataFrame] | None = None
    range_: dict[str, tuple] | None = None
    sloppy_range: bool = False
    filters: dict[str, Callable[[Column], Column] | None] = field(default_factory=dict)
    row_filter: Column | None = None
    rehash: Callable[[Column], Column] | None = None
    hashlabel: str | None = None
    rows: slice | int | None = None
    before: Callable[..., None] | None = None

    def chosen(self) -> list[tuple[int, Dataset, list[int] | None]]:
        """(chain index, link, slices or None for all): what metadata and callbacks leave to be read."""
        if self.range_ is not None and len(self.range_) != 1:
            raise DatasetError("a range is of one column")
        out = []
        for ix, ds in enumerate(self.links):
            if not sum(ds.lines) or self.range_ and not overlaps(ds, *next(iter(self.range_.items()))):
                continue
            if self.hashlabel is not None and ds.hashlabel != self.hashlabel and self.rehash is None:
                raise DatasetError(f"{ds.id} is not hashed on {self.hashlabel}")
            parts = None
            if self.before is not None:
                try:
                    self.before(ds, None)
                    parts = []
                    for k in range(len(ds.lines)):
                        try:
                            self.before(ds, k)
                            parts.append(k)
                        except SkipSlice:
                            pass
                except SkipDataset:
                    continue
                except StopIteration:
                    break
            out.append((ix, ds, parts))
        return out

    def frame(self) -> DataFrame:
        """The rows, with ``_chain_ix``, ``_slice`` and ``_pos``."""
        frames = []
        for ix, ds, parts in self.chosen():
            names = sorted(ds.columns) if not self.columns else self.columns
            extra = [c for c in [*(self.range_ or ()), *([self.hashlabel] if self.rehash else [])] if c not in names]
            df = self.catalog.read(ds, [*names, *extra])
            if isinstance(self.slice_, int) and self.rehash is None:
                df = df.where(F.col("_slice") == self.slice_)
            if parts is not None:
                df = df.where(F.col("_slice").isin(parts))
            frames.append((names, self._one(df, ix, names)))
        if not frames:
            raise DatasetError("nothing is left to read")
        out = frames[0][1]
        for names, df in frames[1:]:
            if (a := dict(out.dtypes)) != (b := dict(df.dtypes)):
                raise DatasetError(f"links differ in types: {set(a.items()) ^ set(b.items())}")
            out = out.unionByName(df)
        return self._cut(out)

    def _one(self, df: DataFrame, ix: int, names: list[str]) -> DataFrame:
        df = df.withColumn("_chain_ix", F.lit(ix))
        if self.range_:
            (column, _), = self.range_.items()
            df = df.withColumn("__range", F.col(f"`{column}`"))
        for column, how in self.translators.items():
            df = translate(df, column, how)
        if self.rehash is not None:
            df = df.withColumn("_slice", self.rehash(F.col(f"`{self.hashlabel}`")))
            if isinstance(self.slice_, int):
                df = df.where(F.col("_slice") == self.slice_)
        if self.row_translator is not None:
            df = self.row_translator(df)
        if self.range_:
            (_, (low, high)), = self.range_.items()
            if not self.sloppy_range:
                df = df.where(F.col("__range").isNotNull())
                df = df.where(F.col("__range") >= F.lit(low)) if low is not None else df
                df = df.where(F.col("__range") < F.lit(high)) if high is not None else df
            df = df.drop("__range")
        for column, how in self.filters.items():
            df = df.where(truthy(df, column) if how is None else how(F.col(f"`{column}`")))
        if self.row_filter is not None:
            df = df.where(self.row_filter)
        return df.select("_chain_ix", "_slice", "_pos", *[f"`{c}`" for c in df.columns if c not in ("_chain_ix", "_slice", "_pos") and (c in names or self.row_translator)])

    def _cut(self, df: DataFrame) -> DataFrame:
        if self.rows is None:
            return df
        from slicewright.plans.ordinals import number_rows

        if self.rows_need_counts() and (self.filters or self.range_ or self.row_filter is not None or self.rehash):
            raise DatasetError("negative rows can't be counted with a filter, range or rehash")
        total = sum(sum(d.lines) if not isinstance(self.slice_, int) else d.lines[self.slice_] for d in self.links)
        start, stop, step = row_window(self.rows, total)
        n = number_rows(df, *self.order(), name="_row")
        return n.where((F.col("_row") >= start) & (F.col("_row") < stop) & ((F.col("_row") - start) % step == 0)).drop("_row")

    def rows_need_counts(self) -> bool:
        parts = [self.rows] if isinstance(self.rows, int) else [self.rows.start, self.rows.stop]
        return any(x is not None and x < 0 for x in parts)

    def order(self) -> list[str]:
        """The columns that put rows in the order of this read."""
        return ["_chain_ix", "_pos", "_slice"] if self.slice_ == "roundrobin" else ["_chain_ix", "_slice", "_pos"]


def overlaps(ds: Dataset, column: str, bounds: tuple) -> bool:
    """Whether any value of a link may be in [low, high), by its metadata."""
    c = ds.columns.get(column)
    if c is None or c.low is None:
        return True
    low, high = bounds
    try:
        return (high is None or c.low < high) and (low is None or c.high >= low)
    except TypeError:  # a date and a time, say: only the rows can tell
        return True


def row_window(rows: slice | int, total: int) -> tuple[int, int, int]:
    """(start, stop, step) of a row slice; a number n is the rows from n on, as a slice would have it."""
    if isinstance(rows, int):
        rows = slice(rows, None)
    step = 1 if rows.step is None else rows.step
    if step <= 0:
        raise DatasetError("the step of a row slice is positive")
    start, stop = (rows.start or 0), (total if rows.stop is None else rows.stop)
    start, stop = (x + total if x < 0 else x for x in (start, stop))
    if start < 0 or stop < 0 or start > total or stop > total or stop < start:
        raise DatasetError(f"rows {rows} of {total}")
    return start, stop, step


def translate(df: DataFrame, column: str, how: dict | Callable[[Column], Column]) -> DataFrame:
    """A column through a function, or a dict in which what is missing is null."""
    if callable(how):
        return df.withColumn(column, how(F.col(f"`{column}`")))
    if len(how) <= INLINE_DICT:
        pairs = [F.lit(x) for kv in how.items() for x in kv]
        return df.withColumn(column, F.try_element_at(F.create_map(*pairs), F.col(f"`{column}`")))
    table = df.sparkSession.createDataFrame(list(how.items()), ["__k", "__v"])  # as large as the caller's own dict
    return df.join(table, F.col(f"`{column}`") == F.col("__k"), "left").withColumn(column, F.col("__v")).drop("__k", "__v")


def truthy(df: DataFrame, column: str) -> Column:
    """Not null, zero, empty or false; NaN is true."""
    c, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind in ("string", "binary"):
        return c.isNotNull() & (F.length(c) > 0)
    return c.isNotNull() & (c != F.lit(0).cast(kind)) if kind in ("int", "bigint", "float", "double") or kind.startswith("decimal") else c.isNotNull()
