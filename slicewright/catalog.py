"""Datasets of sliced rows, their chains, and a catalog of them.

A dataset is a Parquet folder with its columns, ``_slice`` (which horizontal part a row is in) and ``_pos`` (its place there, dense from
0), beside a small metadata record. Both ordinals are data, so no result depends on how Spark lays rows out. Metadata alone answers chains, links,
column selection, counts and ranges; row work makes a DataFrame.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewright.session import shared_dir

ORDINALS = ["_slice", "_pos"]
#: Rows of a slice that one file has at most.
FILE_ROWS = 1 << 22
RANGED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


class DatasetError(Exception):
    """A dataset can't be made or read as asked."""


class SkipDataset(Exception):
    """Raised by a callback: leave this link out."""


class SkipSlice(Exception):
    """Raised by a callback: leave this slice of this link out."""


@dataclass
class Column:
    """Type, where it is stored, and the least and largest value, NaN only where there is nothing else."""

    type: str
    path: str
    low: object = None
    high: object = None
    stored: str | None = None


@dataclass
class Dataset:
    """Metadata of one dataset; ``previous`` links chains, ``parent`` says whose rows its columns extend."""

    id: str
    columns: dict[str, Column]
    lines: list[int]
    previous: str | None = None
    parent: list[str] = field(default_factory=list)
    hashlabel: str | None = None
    filename: str | None = None
    caption: str = ""
    #: Of a typed or derived dataset, the last link that it was made from.
    source: str | None = None

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.columns), sum(self.lines)


class Catalog:
    """Datasets by id (``job/name``, or ``job`` for the default one), with their metadata as JSON files beside the data."""

    def __init__(self, spark: SparkSession, root: str | None = None, slices: int = 4):
        self.spark, self.slices = spark, slices
        self.root = root or f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex[:12]}"
        self.known: dict[str, Dataset] = {}
        self._load()

    # -- metadata files --

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _load(self) -> None:
        fs, at = self._fs(f"{self.root}/_meta")
        if fs.exists(at):
            rows = self.spark.read.option("wholetext", True).text(f"{self.root}/_meta").collect()  # one small file per dataset
            for x in sorted((json.loads(row[0], object_hook=_value) for row in rows), key=lambda x: x.pop("number", 0)):
                self.known[x["id"]] = Dataset(**x | {"columns": {k: Column(**c) for k, c in x["columns"].items()}})

    def register(self, ds: Dataset) -> Dataset:
        if ds.id in self.known:
            raise DatasetError(f"{ds.id} exists already")
        if ds.hashlabel is not None and ds.hashlabel not in ds.columns:
            raise DatasetError(f"hashlabel {ds.hashlabel} is not a column")
        fs, at = self._fs(f"{self.root}/_meta/{uuid.uuid4().hex}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(asdict(ds) | {"number": len(self.known)}, default=_named).encode()))
        out.close()
        self.known[ds.id] = ds
        return ds

    def get(self, name: str | Dataset) -> Dataset:
        if isinstance(name, Dataset):
            return name
        name = name.removesuffix("/default")
        if name not in self.known:
            raise DatasetError(f"no dataset {name}")
        return self.known[name]

    def of_job(self, job: str) -> list[str]:
        """The names of a job's datasets, in the order in which they were finished."""
        return [k.partition("/")[2] or "default" for k in self.known if k.partition("/")[0] == job]

    # -- writing --

    def write(self, name: str, df: DataFrame, previous: str | None = None, hashlabel: str | None = None, filename: str | None = None, caption: str = "", parent: str | None = None, check_hash=None, source: str | None = None) -> Dataset:
        """Store rows that have ``_slice`` and ``_pos``. With ``parent`` the columns extend its rows, of which there must be as many in each slice.

        ``check_hash`` (column -> slice expression) makes a row in the wrong slice an error.
        """
        if hashlabel is not None and check_hash is not None:
            wrong = check_hash(F.col(f"`{hashlabel}`")) != F.col("_slice")
            df = df.withColumn("_slice", F.when(wrong, F.raise_error(F.lit("a row is in the wrong slice"))).otherwise(F.col("_slice")).cast("int"))
        own = [c for c in df.columns if c not in ORDINALS]
        physical = {c: f"c{k}" for k, c in enumerate(own)}  # any text may name a column, but not in a file
        path = f"{self.root}/{uuid.uuid4().hex}"
        stored = df.select(*ORDINALS, *[F.col(f"`{c}`").alias(p) for c, p in physical.items()]) if "" not in own else df.toDF(*[c if c in ORDINALS else physical[c] for c in df.columns])
        stored.repartition("_slice", F.floor(F.col("_pos") / FILE_ROWS)).sortWithinPartitions("_slice", "_pos").write.partitionBy("_slice").parquet(path)
        ranged = [p for c, p in physical.items() if isinstance(df.schema[c].dataType, RANGED)]
        counts, ranges = counts_and_ranges(self.spark.read.schema(stored.schema).parquet(path), ranged)  # without rows there is no file to tell the types
        lines = [counts.get(k, 0) for k in range(self.slices)]
        if sum(counts.values()) != sum(lines):
            raise DatasetError(f"rows in slices beyond {self.slices}")
        columns = {c: Column(df.schema[c].dataType.simpleString(), path, *ranges.get(p, (None, None)), stored=p) for c, p in physical.items()}
        parents = []
        if parent is not None:
            base = self.get(parent)
            if base.lines != lines:
                raise DatasetError(f"{parent} has {base.lines} lines, the new columns {lines}")
            if hashlabel not in (None, base.hashlabel) and base.hashlabel is not None:
                raise DatasetError("the parent has another hashlabel")
            hashlabel = hashlabel or (base.hashlabel if base.hashlabel not in columns else None)
            columns, parents = base.columns | columns, [base.id]
        return self.register(Dataset(name, columns, lines, previous, parents, hashlabel, filename, caption, source))

    # -- metadata operators: no row is read --

    def link(self, name: str, source: str, columns: list[str] | None = None, **changes) -> Dataset:
        """The same rows under another name, with fewer columns, another previous or another filename."""
        ds = self.get(source)
        if columns is not None and (missing := set(columns) - set(ds.columns)):
            raise DatasetError(f"no columns {sorted(missing)}")
        kept = ds.columns if columns is None else {c: ds.columns[c] for c in columns}
        label = ds.hashlabel if ds.hashlabel in kept else None
        return self.register(replace(ds, id=name, columns=dict(kept), hashlabel=label, **changes))

    def filter_columns(self, name: str, source: str, keep: list[str] | None = None, discard: list[str] | None = None) -> Dataset:
        if (keep is None) == (discard is None):
            raise DatasetError("either keep or discard")
        columns = keep if keep is not None else [c for c in self.get(source).columns if c not in discard]
        if not columns:
            raise DatasetError("all columns are discarded")
        return self.link(name, source, columns)

    def merge(self, name: str, sources: list[str], previous: str | None = None, allow_unrelated: bool = False) -> Dataset:
        """Columns side by side by place in slice; later sources win. Rows must be as many in each slice, and of one ancestor."""
        all_of = [self.get(s) for s in sources]
        if len(all_of) < 2:
            raise DatasetError("merge takes two datasets or more")
        if any(d.lines != all_of[0].lines for d in all_of):
            raise DatasetError("the datasets have different lines")
        if not allow_unrelated and len({self.ancestor(d.id) for d in all_of}) > 1:
            raise DatasetError("the datasets have no common ancestor")
        columns: dict[str, Column] = {}
        label = None
        for d in all_of:
            if label in d.columns and d.hashlabel != label:
                label = None
            columns |= d.columns
            if d.hashlabel is not None and label not in (None, d.hashlabel):
                raise DatasetError("the datasets have different hashlabels")
            label = d.hashlabel or label
        return self.register(Dataset(name, columns, all_of[0].lines, previous, [d.id for d in all_of], label if label in columns else None))

    def ancestor(self, name: str) -> str:
        ds = self.get(name)
        while ds.parent:
            ds = self.get(ds.parent[0])
        return ds.id

    def chain(self, last: str, length: int = -1, stop: str | None = None, reverse: bool = False) -> Chain:
        """The links up to ``last``, oldest first: ``length`` of them at most, and none from ``stop`` back."""
        out, at = [], last
        while at is not None and length != len(out) and at != stop:
            ds = self.get(at)
            out.append(ds)
            at = ds.previous
        return Chain(self, out if reverse else out[::-1])

    def made_since(self, previous: str | None, source: str, length: int = -1) -> Chain:
        """The links up to ``source`` that ``previous``, a dataset derived from the same chain, was not made from."""
        return self.chain(source, length, self.get(previous).source if previous is not None else None)

    # -- reading --

    def read(self, ds: str | Dataset, columns: list[str] | None = None) -> DataFrame:
        """The rows with ``_slice``, ``_pos`` and the columns, in name order if none are given; columns of several folders meet on the ordinals."""
        ds = self.get(ds)
        names = sorted(ds.columns) if not columns else columns
        if missing := [c for c in names if c not in ds.columns]:
            raise DatasetError(f"{ds.id} has no columns {missing}")
        folders: dict[str, list[str]] = {}
        for c in names:
            folders.setdefault(ds.columns[c].path, []).append(c)
        if not sum(ds.lines):
            none = T.StructType([T.StructField("_slice", T.IntegerType()), T.StructField("_pos", T.LongType()), *[T.StructField(c, T._parse_datatype_string(ds.columns[c].type)) for c in names]])
            return self.spark.createDataFrame([], none)
        out = None
        for path, own in folders.items():
            part = self.spark.read.parquet(path).select("_slice", "_pos", *[F.col(ds.columns[c].stored).alias(c) for c in own])
            out = part if out is None else out.join(part, ORDINALS)
        return out.select(*ORDINALS, *[F.col(f"`{c}`") if c else out[""] for c in names])


class Chain(list):
    """Datasets in order; what it knows comes from metadata."""

    @property
    def hashlabel(self) -> str | None:
        """The hash label that all links have."""
        found = {d.hashlabel for d in self}
        return found.pop() if len(found) == 1 else None

    def __init__(self, catalog: Catalog, links: list[Dataset]):
        super().__init__(links)
        self.catalog = catalog

    def lines(self, slice_: int | None = None) -> int:
        return sum(sum(d.lines) if slice_ is None else d.lines[slice_] for d in self)

    def column_counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for d in self:
            for c in d.columns:
                out[c] = out.get(c, 0) + 1
        return out

    def with_column(self, column: str) -> Chain:
        return Chain(self.catalog, [d for d in self if column in d.columns])

    def low(self, column: str):
        found = [d.columns[column].low for d in self if column in d.columns and d.columns[column].low is not None]
        clean = [x for x in found if x == x]
        return min(clean or found, default=None)

    def high(self, column: str):
        found = [d.columns[column].high for d in self if column in d.columns and d.columns[column].high is not None]
        clean = [x for x in found if x == x]
        return max(clean or found, default=None)


def least(c):
    """The least value, nulls aside, NaN only if there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(c), c)), F.min(c))


def largest(c):
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.max(c))


def counts_and_ranges(df: DataFrame, columns: list[str]) -> tuple[dict[int, int], dict[str, tuple]]:
    """Rows of each slice, and (least, largest) of each column, in one pass; a row per slice comes to the driver."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        real = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        aggs += [(least if real else F.min)(F.col(c)).alias(f"{c}_low"), (largest if real else F.max)(F.col(c)).alias(f"{c}_high")]
    rows = df.groupBy("_slice").agg(*aggs).collect()

    def over(pick, name: str):
        found = [r[name] for r in rows if r[name] is not None]
        return pick([x for x in found if x == x] or found, default=None)

    return {r["_slice"]: r["n"] for r in rows}, {c: (over(min, f"{c}_low"), over(max, f"{c}_high")) for c in columns}


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """(least, largest) of each column of any rows, in one pass."""
    return counts_and_ranges(df.select(*[F.col(f"`{c}`") for c in columns]).withColumn("_slice", F.lit(0)), columns)[1]


#: How values that JSON has no form for are written, with their kinds.
_KINDS = {"decimal": (Decimal, str, Decimal), "timestamp": (dt.datetime, dt.datetime.isoformat, dt.datetime.fromisoformat), "date": (dt.date, dt.date.isoformat, dt.date.fromisoformat)}


def _named(x):
    for kind, (of, write, _) in _KINDS.items():
        if isinstance(x, of):
            return {f"${kind}": write(x)}
    return str(x)


def _value(x: dict):
    if len(x) == 1 and (kind := next(iter(x)).removeprefix("$")) in _KINDS and f"${kind}" in x:
        return _KINDS[kind][2](x[f"${kind}"])
    return x
