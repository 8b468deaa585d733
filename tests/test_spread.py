"""What a single task reads doesn't grow with the table, and results are the same in parts of any size."""

from contextlib import contextmanager
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from slicewright.operators import aggregate, sorting

ROWS = 4_000


@pytest.fixture
def most_read(spark):
    """Runs a function, gives its result, and the most rows and bytes that a task read from a shuffle."""

    @contextmanager
    def apart():  # small partitions stay as they are
        key = "spark.sql.adaptive.coalescePartitions.enabled"
        spark.conf.set(key, "false")
        yield
        spark.conf.unset(key)

    def run(f):
        sc = spark.sparkContext
        bus, store = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore()

        def stages():
            bus.waitUntilEmpty(30_000)
            found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
            return {(s.stageId(), s.attemptId()) for s in (found.apply(k) for k in range(found.size()))}

        with apart():
            before = stages()
            out = f()
            tasks = [store.taskList(*s, 10_000) for s in stages() - before]
        metrics = [m.get().shuffleReadMetrics() for t in tasks for k in range(t.size()) if (m := t.apply(k).taskMetrics()).isDefined()]
        return out, max(m.recordsRead() for m in metrics), max(m.localBytesRead() + m.remoteBytesRead() for m in metrics)

    return run


def digest(*values):
    return md5("".join(f"{v}\x01" for v in values).encode()).hexdigest()


def text_md5(digests):
    return md5("".join(digests).encode()).hexdigest()


def test_ordered_checksum_is_spread(spark, most_read, monkeypatch):
    monkeypatch.setattr(aggregate, "READ_AT_ONCE", 1, raising=False)
    df = spark.range(ROWS, numPartitions=8).select((ROWS - F.col("id")).alias("a"), (F.col("id") % 4).cast("int").alias("_slice"), F.floor(F.col("id") / 4).alias("_pos"))
    got, _, most = most_read(lambda: aggregate.checksum_ordered(df, ["a"], ["_slice", "_pos"]).first()["checksum"])
    assert got == text_md5(digest(ROWS - i) for s in range(4) for i in range(s, ROWS, 4))
    assert most < ROWS * 16
    none = df.where("a < 0")
    assert aggregate.checksum_ordered(none, ["a"], ["_slice", "_pos"]).first()["checksum"] == text_md5([])


def test_digests_are_joined_in_values_of_any_size(monkeypatch):
    import pyarrow as pa

    digests = [bytes([k]) * 16 for k in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(digests[a:b], pa.binary())], ["at", "d"]) for a, b in ((0, 3), (3, 3), (3, 20), (20, 21), (21, 50))]
    for size in (1, 4, 7, 64):
        monkeypatch.setattr(aggregate, "JOINED_ROWS", size)
        values = [(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in aggregate._joined(iter(batches))]
        assert b"".join(v for _, v in values) == b"".join(digests) and all(len(v) <= 16 * size for _, v in values)
        assert [at for at, _ in values] == [sum(len(v) for _, v in values[:k]) // 16 for k in range(len(values))]


def test_sorted_checksum_is_spread(spark, most_read):
    df = spark.range(ROWS, numPartitions=8).select("id", F.lit("x").alias("same"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("few"))
    for column, values in (("id", range(ROWS)), ("same", ["x"] * ROWS), ("few", [i % 3 or "None\xff" for i in range(ROWS)])):
        got, rows, size = most_read(lambda c=column: aggregate.checksum_sorted(df, [c]).first()["checksum"])
        assert got == text_md5(sorted(map(digest, values)))
        assert rows < ROWS / 2 and size < ROWS * 16


def test_a_slice_is_sorted_in_ranges(spark, most_read):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.range(ROWS, numPartitions=8).select(F.col("id").alias("_n"), (F.col("id") % 7).alias("a"), F.lit("same").alias("A"), F.lit("same").alias("x.y z"), F.lit(0).alias("_slice"), F.col("id").alias("_pos"))
        for by, key in ((["x.y z", "a"], lambda i: i % 7), (["A"], lambda i: 0)):
            out, most, _ = most_read(lambda by=by: sorting.sort_within(df, by).collect())
            assert out[0].__fields__ == ["_n", "a", "A", "x.y z", "_slice", "_pos"]
            assert [tuple(r) for r in sorted(out, key=lambda r: r[5])] == [(i, i % 7, "same", "same", 0, at) for at, i in enumerate(sorted(range(ROWS), key=key))]
            assert most < ROWS / 2
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    with pytest.raises(TypeError, match="pair"):
        sorting.sort_within(spark.range(1).select(F.struct("id").alias("pair"), F.lit(0).alias("_slice"), F.col("id").alias("_pos")), ["pair"])


def test_a_slice_of_few_values_is_sorted_down_in_ranges(spark, most_read):
    days = "case when id % 5 > 0 then date_add(date'2020-01-01', cast(id % 5 as int)) end"
    df = spark.range(ROWS, numPartitions=8).select("id", F.expr(days).alias("day"), F.lit(3).alias("_slice"), F.col("id").alias("_pos"))
    out, most, _ = most_read(lambda: sorting.sort_within(df, ["day"], descending=True).collect())
    assert [r["id"] for r in sorted(out, key=lambda r: r["_pos"])] == sorted(range(ROWS), key=lambda i: -(i % 5 or 9))
    assert most < ROWS / 2
