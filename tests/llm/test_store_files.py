"""A token store has one file for each bucket, not one for each kind of its rows, and its rows reach Python in small batches."""

import public_tokenizers
from pyspark.sql import functions as F

from slicewright.llm import token_store
from slicewright.session import BATCH_ROWS, materialize


def test_files_of_a_store(spark, monkeypatch):
    docs = materialize(spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id")).alias("text")), "texts")
    held, real = [], spark.conf.set
    monkeypatch.setattr(type(spark.conf), "set", lambda self, key, value: held.append((key, value)) or real(key, value))
    store = token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), buckets=4)
    assert held[0] == ("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # the encoding runs first
    table = spark.table(store.name)
    assert len(table.inputFiles()) == 4
    assert table.where("kind = 'recipe'").count() == 3_000 and table.where("kind = 'chunk'").count() == 3_000
    rows = token_store.read(store, ids=False).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == list(range(3_000))
    store.drop()
