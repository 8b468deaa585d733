"""Texts of rows that neither go nor are looked at again don't pass a shuffle, however many they are."""

import random

import pytest
from pyspark.sql import functions as F

from slicewright.llm import exact_dedup, jaccard_join, suffix_dedup
from slicewright.llm.sieve import sieve
from slicewright.session import materialize


def sent(spark):
    """Bytes that shuffles have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.fixture()
def unlike(spark):
    """400 texts of 2,000 random words, the last 10 of which come again under other ids, without broadcasts that hints don't ask for."""
    pick = random.Random(5)
    rows = [(k, " ".join(f"{pick.getrandbits(40):x}" for _ in range(2_000))) for k in range(400)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield rows, materialize(spark.createDataFrame([*rows, *((1000 + k, t) for k, t in rows[-10:])], "doc_id long, text string"), "unlike")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_exact_dedup_leaves_texts_where_they_are(spark, unlike):
    rows, docs = unlike
    began = sent(spark)
    kept = {r["doc_id"]: r["text"] for r in materialize(exact_dedup.dedup(docs), "kept").collect()}
    assert kept == dict(rows[:-10]) | {1000 + k: t for k, t in rows[-10:]}
    assert sent(spark) - began < 0.3 * sum(len(t) for _, t in rows)


def test_near_dedup_shuffles_few_texts(spark, unlike):
    rows, docs = unlike
    described, by_class = jaccard_join._classes(docs, "doc_id", "text", 5, 80)
    lists = sent(spark)
    assert {r["doc_id"]: r["text"] for r in materialize(jaccard_join.keep_first(docs), "kept").collect()} == dict(rows)
    spent = sent(spark) - lists
    began = sent(spark)
    jaccard_join._classes(docs, "doc_id", "text", 5, 80)
    assert spent - (sent(spark) - began) < 0.3 * sum(len(t) for _, t in rows)


def test_suffix_dedup_leaves_texts_where_they_are(spark, unlike):
    rows, docs = unlike
    began = sent(spark)
    removed = {r["doc_id"]: r["n_removed"] for r in materialize(suffix_dedup.remove(docs), "cut").collect()}
    assert removed == {k: 0 for k, _ in rows} | {1000 + k: len(t) for k, t in rows[-10:]}
    assert sent(spark) - began < 1.5 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("count", [0, 1, 5_000])
def test_sieve(spark, count):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("Bit"), F.lit(b"\xff\x80").alias("map"), F.col("id").alias("page"))
    keys = materialize(rows.where(F.col("page") * 3 < count * 12 - 3).where("page % 4 = 0").select("Bit"), "keys")
    assert keys.count() == count
    maybe, clear = sieve(rows, F.col("Bit"), keys)
    assert maybe.columns == clear.columns == rows.columns
    through, rest = {r["page"] for r in maybe.collect()}, {r["page"] for r in clear.collect()}
    assert not through & rest and through | rest == set(range(20_000))
    assert {0 if r["Bit"] is None else r["Bit"] for r in keys.collect()} <= through
    assert len(through) <= count + 20_000 * 0.1
