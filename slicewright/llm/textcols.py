"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words: space and the bytes 9 to 13.
SPACES = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else kept; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    only_ascii = F.length(whole) == F.octet_length(whole)
    return F.when(only_ascii, F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` as an array, empty for null."""
    body = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: which fold a row is in."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``rows`` is called so, in any case."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = f"_{name}"
    return name
