"""Conflict-constrained best-fit packing of documents into token windows.

Documents are dealt by a hash of their ids to shards of about ``SHARD_ROWS``, so that a hot source or group of copies is spread
evenly and each shard is packed in bounded memory. A shard goes from long to short. Open bins are ordered by what they have left, and
each carries a bitmap of its sources and one of its duplicate clusters: the search starts at the tightest bin that is large enough and goes on to
its successors until one has neither the document's source nor its cluster; else a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.llm.exact_dedup import digest_of
from slicewright.llm.textcols import words_of
from slicewright.session import materialize

CAPACITY = 2048
SHARD_ROWS = 2048
_OUT = "doc_id {kind}, piece int, bin_id long, bin_start int, n_tokens int"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, source_conflicts: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(index, piece, bin, start, size) for each piece. Texts over ``capacity`` fill bins of their own, and their rests are packed as others are."""
    numbers: dict[tuple, int] = {}
    bit = lambda kind, value: 1 << numbers.setdefault((kind, value), len(numbers))
    placed, rests, n_bins = [], [], 0
    for i, size in enumerate(sizes):
        whole, rest = divmod(size, capacity)
        for piece in range(whole):
            placed.append((i, piece, n_bins, 0, capacity))
            n_bins += 1
        if rest or not size:
            rests.append((rest, i, whole))
    bits: dict[int, list[int]] = {}  # bin -> [sources, clusters]
    left: list[tuple[int, int]] = []  # (residual, bin), ascending
    for size, i, piece in sorted(rests, key=lambda r: (-r[0], r[1])):
        source = bit("s", sources[i]) if source_conflicts else 0
        cluster = bit("c", clusters[i])
        at = bisect_left(left, (size, -1))
        while at < len(left) and (bits[left[at][1]][0] & source or bits[left[at][1]][1] & cluster):
            at += 1
        if at < len(left):
            residual, chosen = left.pop(at)
        else:
            residual, chosen = capacity, n_bins
            bits[chosen] = [0, 0]
            n_bins += 1
        placed.append((i, piece, chosen, capacity - residual, size))
        bits[chosen][0] |= source
        bits[chosen][1] |= cluster
        insort(left, (residual - size, chosen))
    return placed


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, source_conflicts: bool = True) -> DataFrame:
    """One row per piece of a document: doc_id, piece, bin_id, bin_start, n_tokens (words); a bin never has two documents of one source or of one text.

    Null or empty text has a piece of size 0, null sources are one source, and repeated rows are copies of each other, so they never share a bin.
    Other columns are not read; an empty table gives no rows.
    """
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).alias("size"), F.xxhash64(digest_of(F.col("text"))).alias("cluster"))
    rows = materialize(narrow, "sizes")
    shards = max(1, -(-rows.count() // shard_rows))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        got = best_fit(part["size"].to_pylist(), part["source"].to_pylist(), part["cluster"].to_pylist(), capacity, source_conflicts)
        i, piece, bins, start, n = (list(c) for c in zip(*got, strict=True))
        base = part["shard"][0].as_py() << 32
        ints = [pa.array(piece, pa.int32()), pa.array([base + b for b in bins], pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
        return pa.table([part["doc_id"].take(pa.array(i, pa.int64())), *ints], names=["doc_id", "piece", "bin_id", "bin_start", "n_tokens"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, _OUT.format(kind=docs.schema["doc_id"].dataType.simpleString()))
