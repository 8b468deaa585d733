"""Python workers get derived tables' rows in small batches, whatever the session's own limit is."""

import pyarrow as pa
import pytest

from slicewright.session import BATCH_ROWS, materialize

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def counted(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])


@pytest.mark.parametrize("own", [10_000, 0, 500])
def test_rows_of_a_batch(spark, own):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, str(own))
    sizes = [r["n"] for r in materialize(spark.range(0, 9_000, 1, 1).mapInArrow(counted, "n long"), "sizes").collect()]
    assert spark.conf.get(KEY) == str(own)
    spark.conf.set(KEY, before)
    assert sum(sizes) == 9_000 and max(sizes) == min(own or BATCH_ROWS, BATCH_ROWS)
