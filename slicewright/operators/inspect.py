"""Looking into datasets: grep, cat, reports and the names that tools accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset, DatasetError


def grep(df: DataFrame, pattern: str, columns: list[str] | None = None, ignore_case: bool = False, python: bool = False) -> DataFrame:
    """Rows in which any of the columns matches; Java's regular expressions, or Python's in a vectorised function."""
    names = columns or [c for c in df.columns if not c.startswith("_")]
    if not pattern:
        return df
    if python:
        found = re.compile(pattern, re.I if ignore_case else 0)

        @F.pandas_udf("boolean")
        def match(values):
            return values.map(lambda v: v is not None and found.search(v) is not None)

        tests = [match(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in names]
    else:
        tests = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")).rlike(("(?i)" if ignore_case else "") + pattern) for c in names]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return df.where(hit)


def as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("_slice", "_pos", F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)])).alias("line"))


def report(catalog: Catalog, name: str) -> list[dict]:
    """A record per column: type, least and largest value; all from metadata."""
    ds = catalog.get(name)
    return [{"column": c, "type": x.type, "low": x.low, "high": x.high, "hashlabel": c == ds.hashlabel} for c, x in sorted(ds.columns.items())]


def find(catalog: Catalog, spec: str) -> Dataset:
    """``job/name`` with ``~n`` for the n-th link back and ``^n`` for the n-th parent back."""
    m = re.fullmatch(r"([^~^]+)((?:[~^]\d*)*)", spec)
    if not m:
        raise DatasetError(f"can't read {spec!r}")
    ds = catalog.get(m[1])
    for sign, count in re.findall(r"([~^])(\d*)", m[2]):
        for _ in range(int(count or 1)):
            up = ds.previous if sign == "~" else (ds.parent or [None])[0]
            if up is None:
                raise DatasetError(f"{spec} goes back too far")
            ds = catalog.get(up)
    return ds
