"""In how many lists a set meets others is found with one shuffle of the lists and one of the meetings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewright.llm import jaccard_join
from slicewright.session import materialize
from tests.llm.test_sieve import sent


def some_lists(r, count):
    return [(k, int(r.integers(0, 6)), np.unique(r.integers(0, 60, int(r.integers(0, 12)))).astype(np.uint64)) for k in range(count)]


def met_by(mine, others):
    cls, block, lists = mine
    return sum(any(c != cls and abs(b - block) <= 1 and x in y for c, b, y in others) for x in lists)


@pytest.mark.parametrize("seed", range(4))
def test_meetings(spark, seed):
    r = np.random.default_rng(seed)
    rows = some_lists(r, 40)
    tasks = [rows[:15], rows[10:25], rows[20:], rows[:1], []]  # classes that several tasks have, too
    listed = []
    for task in tasks:
        found = jaccard_join.meet_at_home([x for _, _, x in task], [b for _, b, _ in task])
        listed += [(cls, block, speaks.tolist(), met.tolist()) for (cls, block, _), (speaks, met) in zip(task, found, strict=True)]
    listed = spark.createDataFrame(listed, "class long, block int, lists array<bigint>, met array<bigint>")
    found = {r["class"]: r["c"] for r in jaccard_join._meetings(listed).collect()}
    assert found == {row[0]: c for row in rows if (c := met_by(row, rows))}


def test_one_entry_a_list_and_block():
    lists = [np.array([7], np.uint64)] * 1000
    found = jaccard_join.meet_at_home(lists, [k % 3 for k in range(1000)])
    assert sum(len(speaks) for speaks, _ in found) == 3
    assert all(len(met) == 1 for _, met in found)


def test_what_is_shuffled(spark):
    pick = random.Random(3)
    # a fifth of the words is in other texts too, so each set meets others, but in too few lists
    rows = [(k, " ".join([*(f"w{pick.randrange(500)}" for _ in range(20)), *(f"{pick.getrandbits(60):x}" for _ in range(80))])) for k in range(4_000)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "meeting")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    began = sent(spark)
    described, by_class = jaccard_join._classes(docs, "doc_id", "text", 1, 80)
    spent = sent(spark) - began
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    entries = described.select(F.sum(F.size("met"))).first()[0]
    assert by_class.count() == len(rows) and entries > 20_000
    assert spent < 6_500_000
