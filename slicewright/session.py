"""Sessions and the folder where derived tables go."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Rows that go to a Python worker at once at most: an executor holds each task's batch outside its heap, twice, and texts may be long.
BATCH_ROWS = 2_048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cores: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster's own session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("slicewright").config("spark.driver.memory", memory)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, on one machine only, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(os.environ.get("TMPDIR", "/tmp"), f"slicewright-{os.getpid()}"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends rows to Python workers by ``BATCH_ROWS`` at most, or fewer if the session says so."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize`."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice that finished plans are garbage, so that their shuffle files go now."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
