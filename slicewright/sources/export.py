"""Export to delimited text, with quoting and null rules of its own."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset, DatasetError


@dataclass
class ExportOptions:
    """``quote_fields``: "" for none, else the quote; ``lazy_quotes``: only where needed; ``none_as``: one text, or a text by label."""

    separator: str = ","
    line_separator: str = "\n"
    labelsonfirstline: bool = True
    quote_fields: str = ""
    lazy_quotes: bool = False
    none_as: str | dict[str, str] | None = None
    labels: list[str] = field(default_factory=list)


def _float_text(c: Column) -> Column:
    """Python's shortest form of a float."""

    @F.pandas_udf("string")
    def text(values):
        return values.map(lambda v: None if v is None else repr(float(v)))

    return F.when(c.isNotNull(), F.when(F.isnan(c), F.lit("nan")).otherwise(text(c.cast("double"))))


def value_text(df: DataFrame, column: str) -> Column:
    kind, c = dict(df.dtypes)[column], F.col(f"`{column}`")
    if kind in ("float", "double"):
        return _float_text(c)
    if kind == "boolean":
        return F.initcap(c.cast("string"))
    if kind == "binary":
        return F.make_valid_utf8(c.cast("string"))
    if kind.startswith(("struct", "array", "map", "variant")):
        return F.to_json(c)
    return c.cast("string")


def quoted(text: Column, o: ExportOptions) -> Column:
    if not o.quote_fields:
        return text
    q = o.quote_fields
    full = F.concat(F.lit(q), F.replace(text, F.lit(q), F.lit(q + q)), F.lit(q))
    if not o.lazy_quotes or not o.separator:
        return full
    need = F.lit(False)
    for mark in ("'", '"') if q in "'\"" else (q,):
        need = need | text.startswith(mark) | text.endswith(mark)
    return F.when(need | text.contains(o.separator), full).otherwise(text)


def lines(df: DataFrame, options: ExportOptions | None = None) -> DataFrame:
    """The rows as text: the ordinals and ``line``."""
    o = options or ExportOptions()
    labels = o.labels or sorted(c for c in df.columns if not c.startswith("_"))
    fields = []
    for c in labels:
        none = o.none_as.get(c, "None") if isinstance(o.none_as, dict) else "None" if o.none_as is None else o.none_as
        fields.append(F.coalesce(quoted(value_text(df, c), o), F.lit(none)))
    joined = [x for k, f in enumerate(fields) for x in ([F.lit(o.separator)] if k else []) + [f]]
    return df.select(*[c for c in ("_chain_ix", "_slice", "_pos") if c in df.columns], F.concat(*joined).alias("line"))


def header(labels: list[str], o: ExportOptions) -> str:
    q = o.quote_fields
    need = lambda x: q and (not o.lazy_quotes or not o.separator or o.separator in x or x[:1] in "'\"" and x != "" or x[-1:] in "'\"" and x != "")
    return o.separator.join(q + x.replace(q, q + q) + q if need(x) else x for x in labels)


def _write(rows: DataFrame, labels: list[str], path: str, o: ExportOptions, sliced: bool) -> None:
    order = [c for c in ("_chain_ix", "_slice", "_pos") if c in rows.columns]
    writer_options = {"lineSep": o.line_separator} | ({"compression": "gzip"} if path.endswith(".gz") or ".gz." in path else {})
    if o.labelsonfirstline:
        first = F.lit(header(labels, o))
        alone = rows.sparkSession.range(1).select(*[F.lit(-1).cast(dict(rows.dtypes)[c]).alias(c) for c in order], first.alias("line"))
        each = rows.select("_slice").distinct().withColumns({c: F.lit(-1).cast(dict(rows.dtypes)[c]) for c in order if c != "_slice"} | {"line": first}) if sliced else None
        rows = rows.unionByName(each if sliced else alone)
    if sliced:
        rows.repartition("_slice").sortWithinPartitions("_slice", *order).select("_slice", "line").write.partitionBy("_slice").options(**writer_options).text(path)
    else:
        rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.options(**writer_options).text(path)


def write_csv(df: DataFrame, path: str, options: ExportOptions | None = None, sliced: bool = False) -> None:
    """Text files under ``path`` in the order of the rows, by slice if ``sliced``; a path that ends in .gz is compressed."""
    o = options or ExportOptions()
    _write(lines(df, o), o.labels or sorted(c for c in df.columns if not c.startswith("_")), path, o, sliced)


def chain_lines(catalog: Catalog, links: list[Dataset], options: ExportOptions | None = None) -> DataFrame:
    """The rows of links as text, with their ordinals; each link is written by its own types, and the first one's columns are the labels where none are given."""
    o = options or ExportOptions()
    if not links:
        raise DatasetError("there is no link to export")
    own = replace(o, labels=o.labels or sorted(links[0].columns))
    return reduce(DataFrame.unionByName, [lines(catalog.read(ds, own.labels).withColumn("_chain_ix", F.lit(ix)), own) for ix, ds in enumerate(links)])


def export_chain(catalog: Catalog, last: str, path: str, options: ExportOptions | None = None, exported: str | None = None, length: int = -1, sliced: bool = False) -> Dataset:
    """Write the links up to ``last`` that came after ``exported``, the last link of an earlier export; returns the last link, for the next one."""
    o = options or ExportOptions()
    links = catalog.chain(last, length, exported)
    _write(chain_lines(catalog, links, o), o.labels or sorted(links[0].columns), path, o, sliced)
    return links[-1]
