"""Rows that may have one of many keys, told from those that can't without a shuffle.

A join that keeps or drops a few rows of a wide table would shuffle all of it. A bitmap of hashed keys, small enough to be broadcast, shows for most rows
that they have none of the keys; only the others need the join. Bits are shared, so rows may be let through in vain, but none with a key is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.llm.textcols import free_name

#: Bits of a page, pages at most (16 MB in all; beyond that more rows are let through) and bits for each key.
PAGE, PAGES, BITS = 1 << 15, 1 << 12, 16


def sieve(rows: DataFrame, value: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``value`` may be among ``keys``, rows whose is not), with the columns of ``rows``.

    ``keys`` is a written table of one column, of the type of ``value``; null is a value like others.
    """
    count = keys.count()
    bits = PAGE * min(PAGES, count * BITS // PAGE + 1)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = bit(F.col(f"`{keys.columns[0]}`"))
    pages = keys.select(F.shiftright(at, 15).alias("page"), (at % PAGE).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map"))
    place, page, held = (free_name(rows, c) for c in ("bit", "page", "map"))
    known = rows.withColumn(place, bit(value)).join(F.broadcast(pages.toDF(page, held)), F.shiftright(place, 15) == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(held, F.shiftright((F.col(place) % PAGE).cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    return known.where(may).select(*columns), known.where(~may).select(*columns)
