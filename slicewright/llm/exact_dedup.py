"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch (Misra-Gries counters, merged across tasks) names at most ``TRACKED`` digests
that may be frequent. Their exact counts and largest ids, at most that many rows, are broadcast, and each task drops
what loses to a broadcast winner before any shuffle. What is left, light groups and the winners themselves,
is shuffled by digest, so no key of that shuffle holds a share of the rows much above ``1/HEAVY``: the sketch may miss one by its error, some ``1/TRACKED``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewright.llm.sieve import sieve
from slicewright.llm.textcols import ascii_lower, free_name
from slicewright.session import drop_materialized, materialize

#: Counters of the sketch, and so the bound on what is broadcast.
TRACKED = 4096
#: The most digests treated as heavy.
HEAVY = 1024


def digest_of(text: Column) -> Column:
    """sha256, lower-case hex, of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def winners(digests: DataFrame, digest: str = "__digest", doc_id: str = "__id") -> DataFrame:
    """Verified heavy groups: digest, the id that stays, exact size; at most ``HEAVY`` rows."""
    top = digests.agg(F.expr(f"approx_top_k({digest}, {HEAVY}, {TRACKED})").alias("top"))
    likely = top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(digest)).where(f"{digest} is not null")
    exact = digests.join(F.broadcast(likely), digest, "left_semi").groupBy(digest).agg(F.max(doc_id).alias("__win"), F.count(F.lit(1)).alias("__size"))
    return exact.where("__size > 1")


def split(rows: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that lost map-side, rows to shuffle): ``rows`` have __digest and __id."""
    known = rows.join(F.broadcast(heavy), "__digest", "left")
    lost = F.col("__size").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__win"))
    return known.where(lost), known.where(~lost)


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("__id"), digest_of(F.col(f"`{text}`")).alias("__digest"))


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null ids are smallest. Rows that share id and text
    are ties, of which one stays. Other columns, whatever their names, are not read. An empty table gives none.
    """
    narrow = materialize(_narrow(docs, doc_id, text), "digests")
    lost, rest = split(narrow, winners(narrow))
    group = Window.partitionBy("__digest")
    ranked = rest.select(
        "__id",
        F.coalesce("__win", F.max("__id").over(group)).alias("__keep"),
        F.coalesce("__size", F.count(F.lit(1)).over(group)).alias("__n"),
        (F.row_number().over(group.orderBy(F.col("__id").desc_nulls_last())) == 1).alias("__kept"),
        "__digest",
    )
    all_rows = ranked.unionAll(lost.select("__id", "__win", "__size", F.lit(False), "__digest"))
    return all_rows.toDF(doc_id, "keep_id", "group_size", "kept", "text_sha256")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whole and with their own columns; rules as for :func:`decide`. Of rows that share id and text one stays.

    Which rows go is found from ids and digests alone; a text is only shuffled if its id may be that of a row that goes or is repeated.
    """
    narrow = materialize(_narrow(docs, doc_id, text), "digests")
    lost, rest = split(narrow, winners(narrow))
    last = Window.partitionBy("__digest")
    ranked = rest.select("__id", "__digest", F.max("__id").over(last).alias("__last"))
    goes = ~F.col("__id").eqNullSafe(F.col("__last"))
    seen = ranked.select("__id", "__digest", goes.alias("goes")).unionAll(lost.select("__id", "__digest", F.lit(True)))
    odd = materialize(seen.groupBy("__id", "__digest").agg(F.max("goes").alias("goes"), F.count(F.lit(1)).alias("c")).where("goes or c > 1"), "odd").toDF("i", "d", "goes", "c")
    drop_materialized(narrow)
    maybe, clear = sieve(docs, F.col(f"`{doc_id}`"), odd.select("i"))
    digest = free_name(docs, "digest")
    rows = maybe.withColumn(digest, digest_of(F.col(f"`{text}`")))
    i, d = free_name(docs, "i"), free_name(docs, "d")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(i)) & (F.col(digest) == F.col(d))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.join(odd.select(F.col("i").alias(i), F.col("d").alias(d)), same, "left_anti").select(*columns)
    again = odd.where("not goes")
    if again.isEmpty():
        return clear.unionAll(once)
    repeated = rows.join(again.select(F.col("i").alias(i), F.col("d").alias(d)), same, "left_semi")
    rank = free_name(docs, "rank")
    first = F.row_number().over(Window.partitionBy(F.col(f"`{doc_id}`"), digest).orderBy(F.lit(0)))
    return clear.unionAll(once).unionAll(repeated.withColumn(rank, first).where(F.col(rank) == 1).select(*columns))


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
window w as (partition by t)
"""
