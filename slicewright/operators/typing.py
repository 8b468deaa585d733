"""Typing text columns: all columns are converted in one pass, then bad values fail, get a default, or drop their row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset
from slicewright.functions.converters import converter
from slicewright.functions.hashing import md5_slice
from slicewright.plans.ordinals import dense_places
from slicewright.plans.scan import Scan

#: Bad line numbers that a report lists.
REPORTED = 32


@dataclass
class TypeSpec:
    """``types`` by old name; ``rename`` old to new, None to discard; ``defaults`` by old name, as text, or None for null."""

    types: dict[str, str]
    rename: dict[str, str | None] = field(default_factory=dict)
    defaults: dict[str, str | None] = field(default_factory=dict)
    filter_bad: bool = False
    discard_untyped: bool = False
    numeric_comma: bool = False
    timezone: str | None = None

    def out_names(self, columns: list[str]) -> dict[str, str]:
        """Old to new names of what is kept."""
        kept = {c: self.rename.get(c, c) for c in columns if not c.startswith("_") and (c in self.types or not self.discard_untyped)}
        kept = {c: n for c, n in kept.items() if n is not None}
        named = {n for c, n in kept.items() if c in self.rename}
        kept = {c: n for c, n in kept.items() if c in self.rename or n not in named}  # a renamed column takes the place of an old one
        if len(set(kept.values())) < len(kept):
            raise ValueError("two columns would have one name")
        if missing := set(self.types) - set(columns):
            raise ValueError(f"no columns {sorted(missing)}")
        return kept


def converted(df: DataFrame, spec: TypeSpec) -> DataFrame:
    """``df`` with a struct (ok, value) ``__t_<name>`` beside each typed column. Null text stays null in text types and counts as empty in others."""
    out = {}
    for c, kind in spec.types.items():
        x = F.col(f"`{c}`")
        if not kind.startswith(("bytes", "ascii", "unicode", "json", "complex")):
            x = F.coalesce(x, F.lit(""))
        out[f"__t_{c}"] = converter(kind, spec.numeric_comma, spec.timezone)(x)
    return df.withColumns(out)


def dataset_type(df: DataFrame, spec: TypeSpec) -> DataFrame:
    """The typed rows. Without ``filter_bad`` a bad value without a default fails the query."""
    names = spec.out_names(df.columns)
    rows = converted(df, spec)
    columns = []
    for c, new in names.items():
        if c not in spec.types:
            columns.append(F.col(f"`{c}`").alias(new))
            continue
        t = F.col(f"`__t_{c}`")
        if c in spec.defaults:
            default = F.lit(spec.defaults[c])
            given = converter(spec.types[c], spec.numeric_comma, spec.timezone)(default)["value"] if spec.defaults[c] is not None else F.lit(None)
            columns.append(F.when(t["ok"], t["value"]).otherwise(given).alias(new))
        elif spec.filter_bad:
            columns.append(t["value"].alias(new))
        else:
            columns.append(F.when(t["ok"], t["value"]).otherwise(F.raise_error(F.concat(F.lit(f"{c}: bad value "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))))).alias(new))
    if spec.filter_bad:
        for c in spec.types:
            if c not in spec.defaults:
                rows = rows.where(F.col(f"`__t_{c}`")["ok"])
    return rows.select(*[c for c in df.columns if c.startswith("_")], *columns)


def type_chain(
    catalog: Catalog, name: str, source: str, spec: TypeSpec, previous: str | None = None, length: int = -1, as_chain: bool = False, hashlabel: str | None = None, how: Callable[[Column, int], Column] = md5_slice
) -> Dataset:
    """Type the links up to ``source`` into one dataset that follows ``previous``.

    Links that ``previous`` was made from are not typed again; ``length`` says how many links there are at most. With ``hashlabel``, a new name, rows go to the slice of
    their value, in the order of link, old slice and place. ``as_chain`` makes a link of its own for each old slice, ``name/0`` on, the last one called ``name``. Places are dense
    again after ``filter_bad``; a chain without links is an error.
    """
    chain = catalog.made_since(previous, source, length)
    typed = dataset_type(Scan(catalog, chain).frame(), spec)
    if hashlabel is not None:
        typed = typed.withColumn("_old", F.col("_slice")).withColumn("_slice", how(F.col(f"`{hashlabel}`"), catalog.slices))
    elif as_chain:
        typed = typed.withColumn("_old", F.col("_slice"))
    order = [c for c in ("_chain_ix", "_old", "_pos") if c in typed.columns]
    label = hashlabel if hashlabel is not None else next((n for n in [chain[-1].hashlabel] if n in spec.out_names(sorted(chain[-1].columns)) and n not in spec.types and n not in spec.rename), None)
    if not as_chain:
        return catalog.write(name, dense_places(typed, *order), previous, label, source=source)
    out = previous
    for k in range(catalog.slices):
        last = k == catalog.slices - 1
        out = catalog.write(name if last else f"{name}/{k}", dense_places(typed.where(F.col("_old") == k), *order), out, label, source=source).id
    return catalog.get(out)


def bad_report(df: DataFrame, spec: TypeSpec) -> DataFrame:
    """By slice and column: bad values, and the places of the first of them."""
    rows = converted(df, spec)
    each = [F.struct(F.lit(c).alias("column"), F.col(f"`__t_{c}`")["ok"].alias("ok")) for c in spec.types]
    long = rows.select("_slice", "_pos", F.explode(F.array(*each)).alias("x")).where(~F.col("x.ok"))
    first = F.slice(F.sort_array(F.collect_list("_pos")), 1, REPORTED)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("_slice", "x.column").orderBy("_pos"))
    few = long.withColumn("__rank", rank).select("_slice", F.col("x.column").alias("column"), F.when(F.col("__rank") <= REPORTED, F.col("_pos")).alias("_pos"))
    return few.groupBy("_slice", "column").agg(F.count(F.lit(1)).alias("bad"), first.alias("first_lines"))
