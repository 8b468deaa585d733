"""Import of delimited text: every line becomes a good row, a bad line or a skipped line, with its number.

Lines are found by Spark's splittable text reader, numbered densely across files and splits, and taken apart byte for byte where they are.
Nothing is inferred: all fields are bytes, and typing is a step of its own.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.catalog import Catalog, Dataset
from slicewright.plans.ordinals import deal, number_rows
from slicewright.session import materialize, shared_dir


@dataclass
class CsvOptions:
    """``quotes``: False, True for both ' and ", or one character; ``newline`` empty for line feeds with or without a carriage return; ``separator`` empty for one field a line."""

    separator: str = ","
    newline: str = ""
    quotes: bool | str = False
    comment: str = ""
    labelsonfirstline: bool = True
    labels: list[str] = field(default_factory=list)
    strip_labels: bool = False
    rename: dict[str, str] = field(default_factory=dict)
    discard: set[str] = field(default_factory=set)
    lineno_label: str = ""
    allow_bad: bool = False
    allow_extra_empty: bool = False
    skip_lines: int = 0
    skip_empty_lines: bool = False


@dataclass
class Imported:
    """``good`` has a binary column per label with ``_slice`` and ``_pos``; ``bad`` and ``skipped`` have lineno and data."""

    good: DataFrame
    bad: DataFrame
    skipped: DataFrame
    labels: list[str]

    def counts(self) -> dict[str, int]:
        return {"lines": self.good.count(), "bad": self.bad.count(), "skipped": self.skipped.count()}


class BadLine(Exception):
    """A line that is not as the options say."""


def fields_of(line: bytes, separator: bytes, quotes: bool | str) -> list[bytes]:
    """The fields of a line; a quoted one ends at its quote, which must be followed by a separator or the end, and a doubled quote is one."""
    if not quotes:
        return line.split(separator) if separator else [line]
    marks = b"'\"" if quotes is True else quotes.encode("latin-1")
    out, at = [], 0
    while True:
        if at < len(line) and line[at : at + 1] in [marks[i : i + 1] for i in range(len(marks))]:
            mark, value, at = line[at : at + 1], b"", at + 1
            while True:
                end = line.find(mark, at)
                if end < 0:
                    raise BadLine("a quote is not closed")
                value += line[at:end]
                at = end + 1
                if line[at : at + 1] != mark:
                    break
                value += mark
                at += 1
            out.append(value)
            if at == len(line):
                return out
            if not separator or not line.startswith(separator, at):
                raise BadLine("text after a quote")
            at += len(separator)
        else:
            end = line.find(separator, at) if separator else -1
            if end < 0:
                out.append(line[at:])
                return out
            out.append(line[at:end])
            at = end + len(separator)


def _parser(n: int, options: CsvOptions):
    separator = options.separator.encode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for line in batch.column("data").to_pylist():
                try:
                    got: list[bytes] | None = fields_of(line, separator, options.quotes)
                    if options.allow_extra_empty:
                        while len(got) > n and got[-1] == b"":
                            got.pop()
                    if len(got) != n:
                        got = None
                except BadLine:
                    got = None
                values.append(got)
            yield batch.append_column("fields", pa.array(values, pa.list_(pa.binary())))

    return run


def numbered_lines(spark: SparkSession, path: str, newline: str = "") -> DataFrame:
    """lineno (from 1) and data of each physical line, gzip or not."""
    reader = spark.read.option("lineSep", newline or "\n")
    lines = reader.text(path).select(F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    lines = lines.withColumn("__id", F.monotonically_increasing_id())
    numbered = number_rows(lines, "__file", "__block", "__id", name="lineno")
    data = F.col("data")
    if not newline:
        ends = F.substring(data, -1, 1) == F.lit(b"\r")
        data = F.when(ends, F.substring(data, F.lit(1), F.octet_length(data) - 1)).otherwise(data)
    return numbered.select((F.col("lineno") + 1).alias("lineno"), data.alias("data"))


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None, slices: int = 4) -> Imported:
    """Import a file; without ``allow_bad`` one bad line fails the import, and so does a file without labels."""
    o = options or CsvOptions()
    lines = numbered_lines(spark, path, o.newline)
    skip = F.col("lineno") <= o.skip_lines
    if o.comment:
        skip = skip | (F.substring(F.col("data"), 1, 1) == F.lit(o.comment.encode("latin-1")))
    if o.skip_empty_lines:
        skip = skip | (F.octet_length("data") == 0)
    lines = materialize(lines.withColumn("skip", skip), "lines")
    content = lines.where("not skip").drop("skip")
    labels = o.labels
    if o.labelsonfirstline:
        first = content.orderBy("lineno").first()
        if first is None and not labels:
            raise ValueError("no line has labels")
        if first is not None:
            content = content.where(F.col("lineno") > first["lineno"])
            if not labels:
                labels = [x.decode("utf-8") for x in fields_of(bytes(first["data"]), o.separator.encode("latin-1"), o.quotes)]
                while o.allow_extra_empty and labels and not labels[-1]:
                    labels.pop()
    if o.strip_labels:
        labels = [x.strip() for x in labels]
    labels = [o.rename.get(x, x) for x in labels]
    if len(set(labels)) < len(labels):
        raise ValueError("two labels are the same")
    kept = [x for x in labels if x not in o.discard]
    parsed = materialize(content.mapInArrow(_parser(len(labels), o), "lineno long, data binary, fields array<binary>"), "parsed")
    bad = parsed.where("fields is null").select("lineno", "data")
    if not o.allow_bad and not bad.isEmpty():
        line = bad.orderBy("lineno").first()
        raise BadLine(f"line {line['lineno']}: {bytes(line['data'])!r}")
    good = parsed.where("fields is not null").select("lineno", *[F.col("fields")[k].alias(x) for k, x in enumerate(labels) if x in kept])
    n = F.col("lineno") - 1 - (0 if not o.labelsonfirstline else 1)
    good = good.withColumn("_slice", F.pmod(n, F.lit(slices)).cast("int"))
    from pyspark.sql import Window

    good = good.withColumn("_pos", F.row_number().over(Window.partitionBy("_slice").orderBy("lineno")).cast("long") - 1)
    columns = [F.col("lineno").alias(o.lineno_label)] if o.lineno_label else []
    good = good.select("_slice", "_pos", *columns, *[F.col(f"`{x}`") for x in kept])
    return Imported(good, bad, lines.where("skip").select("lineno", "data"), kept)


def import_link(catalog: Catalog, name: str, path: str, options: CsvOptions | None = None, previous: str | None = None) -> Dataset:
    """A file as a link of a chain, with ``name/bad`` and ``name/skipped`` beside it, which follow those of ``previous``."""
    got = read_csv(catalog.spark, path, options, catalog.slices)
    for kind, rows in (("bad", got.bad), ("skipped", got.skipped)):
        before = f"{previous}/{kind}" if f"{previous}/{kind}" in catalog.known else None
        catalog.write(f"{name}/{kind}", deal(number_rows(rows, "lineno"), catalog.slices).drop("_ord"), before, filename=path)
    return catalog.write(name, got.good, previous, filename=path)


def read_zip(spark: SparkSession, path: str, options: CsvOptions | None = None, include: str | None = None, exclude: str | None = None, strip_dirs: bool = False, slices: int = 4) -> dict[str, Imported]:
    """Each file in a local zip archive by its cleaned name; the archive's index is read on the driver, and members go to the shared folder."""
    import re
    import uuid

    out: dict[str, Imported] = {}
    base = f"{shared_dir(spark)}/zip-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    with zipfile.ZipFile(path) as z:
        for k, info in enumerate(z.infolist()):
            if info.is_dir() or include and not re.search(include, info.filename) or exclude and re.search(exclude, info.filename):
                continue
            name = info.filename.rpartition("/")[2] if strip_dirs else info.filename
            name = re.sub(r"[^\w.-]", "_", name)
            while name in out or name == "default":
                name += "_"
            at = jvm.org.apache.hadoop.fs.Path(f"{base}/{k}" + (".gz" if info.filename.endswith(".gz") else ""))
            stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
            with z.open(info) as member:
                while chunk := member.read(1 << 20):
                    stream.write(bytearray(chunk))
            stream.close()
            out[name] = read_csv(spark, at.toString(), options, slices)
    return out
