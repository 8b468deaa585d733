"""Chains as streams: rows that are appended to a folder become the next link, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from slicewright.catalog import Catalog, Dataset
from slicewright.plans.ordinals import deal, number_rows


def append_links(spark: SparkSession, catalog: Catalog, folder: str, schema: StructType, job: str, order: list[str], checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> list[Dataset]:
    """Read what is new in ``folder`` and write it as links of the chain of ``job``; the checkpoint says what has been read, and a batch that is seen again is not written again."""
    made: list[Dataset] = []

    def link(batch: DataFrame, number: int) -> None:
        name = f"{job}-{number}"
        if name in catalog.known or batch.isEmpty():
            return
        before = max((int(k[len(job) + 1 :]) for k in catalog.known if k.startswith(f"{job}-") and k[len(job) + 1 :].isdecimal()), default=None)
        rows = deal(number_rows(prepare(batch) if prepare else batch, *order), catalog.slices).drop("_ord")
        made.append(catalog.write(name, rows, previous=None if before is None else f"{job}-{before}"))

    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return made
