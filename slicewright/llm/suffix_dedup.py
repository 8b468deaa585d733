"""Removal of repeated passages with two-stage suffix sorting.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier: in a smaller doc_id, or before in the same document. A document is an id with its text,
known by a digest of 128 bits; different texts of one id are documents of their own, in the order of their digests, and rows of equal id and text are one.

1. Equal texts: all but the first go whole, so copies of documents take no further part.
2. Anchors: of the ``GRAM``-byte hashes that start in any ``LENGTH``-byte string the least ones are anchors, so equal strings have equal anchors at equal places.
   Anchors that occur once are done with.
3. The surroundings of repeated anchors, all strings of ``LENGTH`` bytes in which the anchor is least, are dealt by anchor. Of equal surroundings the first stays, in each task before
   the shuffle and once more after it; the others are repeats as a whole. What is left is joined into blocks and sorted: suffixes smaller than their
   successors directly, all others by scanning the buckets of first bytes in order. Runs of adjacent common prefixes of ``LENGTH`` and more
   are equal strings, of which all but the earliest are repeats.
4. The repeated stretches go to their documents, which are cut and hashed.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewright.llm.sieve import sieve
from slicewright.session import drop_materialized, materialize, release

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of surroundings that are sorted together, about.
BLOCK_BYTES = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


class Powers:
    """Powers of the hash's base and of its inverse modulo 2^64, grown when needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)))
                self.down = np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)))
        return self.up[:n], self.down[:n]


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, first, last) of the anchors of a text: an anchor is the least hash in the strings that start from first to last."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    up, down = powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.frombuffer(data, np.uint8).astype(np.uint64) * up + up, out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h ^= h >> np.uint64(29)
    least = _sliding(h, SPAN, np.minimum)
    padded = np.zeros(len(least) + 2 * (SPAN - 1), np.uint64)
    padded[SPAN - 1 : SPAN - 1 + len(least)] = least
    places = np.flatnonzero(_sliding(padded, SPAN, np.maximum) == h)
    runs = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    stops = np.append(runs[1:], len(least)) - 1
    low, high = np.maximum(places - SPAN + 1, 0), np.minimum(places, len(least) - 1)
    run = np.searchsorted(runs, low, side="right") - 1
    while len(wrong := np.flatnonzero(least[runs[run]] != h[places])):
        run[wrong] += 1
    return places, h[places].view(np.int64), np.maximum(low, runs[run]), np.minimum(high, stops[run])


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffix starts in the order of their first ``depth`` bytes (or more), by two-stage sorting; the text ends with zeros beyond its end."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    buffer = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    known = np.append(np.where(step != 0, np.arange(n - 1), n - 1), n - 1)
    ahead = np.minimum.accumulate(known[::-1])[::-1]
    smaller = np.append(step, -1)[ahead] > 0  # than the suffix that starts one later
    words = np.ndarray((n + depth + 8,), ">u8", buffer.tobytes(), strides=(1,)).astype(np.uint64)
    direct = _sort_direct(np.flatnonzero(smaller), words, depth)
    split = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        rows = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket, layer = [rows], rows
        while len(layer):  # what precedes a larger suffix with the same byte is larger too, and follows
            layer = layer[layer > 0] - 1
            layer = layer[(text[layer] == c) & ~smaller[layer]]
            bucket.append(layer)
        bucket.append(direct[split[c] : split[c + 1]])
        rows = np.concatenate(bucket)
        if not len(rows):
            continue
        out.append(rows)
        before = rows[rows > 0] - 1
        first = text[before]
        before, first = before[(first > c)], first[first > c]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            ends = np.flatnonzero(np.append(first[1:] != first[:-1], True)) + 1
            for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                waiting[first[lo]].append(before[lo:hi])
    return np.concatenate(out)


def _sort_direct(starts: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Sort by eight bytes at a time; only what is still equal is looked at again."""
    order = starts[np.argsort(words[starts], kind="stable")]
    key = words[order]
    same = np.append(False, key[1:] == key[:-1])
    for at in range(8, depth, 8):
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        group = np.cumsum(~same)[tied]
        rows = order[tied]
        key = words[rows + at]
        inner = np.lexsort((key, group))
        order[tied] = rows[inner]
        key = key[inner]
        again = np.append(False, (key[1:] == key[:-1]) & (group[1:] == group[:-1]))
        same[tied] = again
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each suffix in order, the bytes that it has in common with the one before it, ``most`` at most."""
    n = len(text)
    buffer = np.concatenate([text, np.zeros(most + 16, np.uint8)]).tobytes()
    words = np.ndarray((n + most + 8,), ">u8", buffer, strides=(1,)).astype(np.uint64)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, most, 8):
        differ = words[order[alive] + at] ^ words[order[alive - 1] + at]
        equal = differ == 0
        some = differ[~equal]
        lead = np.zeros(len(some), np.int64)
        for k in range(1, 8):
            lead += some < np.uint64(1 << (64 - 8 * k))
        out[alive[~equal]] = at + lead
        alive = alive[equal]
    out[alive] = most
    return np.minimum(out, most)


def repeats(pieces: list[bytes], places: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """For each piece, at (document, start), the stretches of it that are covered by strings which start earlier in some piece."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    order = suffix_array(text)
    inside = np.arange(len(text)) + LENGTH <= (begin + sizes)[owner]
    order_of = np.lexsort((np.array([p[1] for p in places]), np.array([p[0] for p in places])))
    rank = np.empty(len(pieces), np.int64)
    doc, start = np.array([p[0] for p in places]), np.array([p[1] for p in places])
    new_doc = np.append(True, doc[order_of][1:] != doc[order_of][:-1])
    rank[order_of] = np.cumsum(new_doc) - 1
    key = (rank[owner] << 36) + start[owner] + np.arange(len(text)) - begin[owner]  # where the suffix stands among all texts
    run = np.cumsum(common_prefixes(text, order) < LENGTH) - 1
    good = inside[order]
    first = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, run[good], key[order[good]])
    late = order[good & (key[order] > first[run])]
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for at in np.sort(late).tolist():
        mine = out[owner[at]]
        local = at - int(begin[owner[at]])
        if mine and mine[-1][1] >= local:
            mine[-1] = (mine[-1][0], local + LENGTH)
        else:
            mine.append((local, local + LENGTH))
    return out


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        lists = []
        for text in batch.column("text").to_pylist():
            found, times = np.unique(anchors((text or "").encode(), powers)[1], return_counts=True)
            lists.append(np.concatenate([found, found[times > 1]]))  # twice is enough to show that it is repeated
        yield batch.drop_columns(["text"]).append_column("anchors", pa.array(lists, pa.list_(pa.int64())))


_ROUND = "doc long, digest binary, start int, stop int, anchor long, left int, piece binary"
_ROUND_SCHEMA = pa.schema([("doc", pa.int64()), ("digest", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("anchor", pa.int64()), ("left", pa.int32()), ("piece", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUND_SCHEMA.types, strict=True)], schema=_ROUND_SCHEMA)


def _surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each repeated anchor its surroundings, or only the stretch if this task has had equal ones from an earlier place."""
    powers, seen, rows, size = Powers(), {}, [], 0
    for batch in batches:
        for doc, digest, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "digest", "text", "wanted")), strict=True):
            data = (text or "").encode()
            found = anchors(data, powers)
            chosen = np.isin(found[1], np.array(wanted, np.int64))
            for place, anchor, start, last in zip(*(x[chosen].tolist() for x in found), strict=True):
                stop = last + LENGTH
                piece = data[start:stop]
                key = (anchor, place - start, hashlib.blake2b(piece, digest_size=16).digest())
                at = (doc, digest, start)
                before = seen.get(key)
                if before == at:  # the same document in another row
                    continue
                if before is not None and before < at:
                    rows.append((*at, stop, None, None, None))
                else:
                    seen[key] = at
                    rows.append((*at, stop, anchor, place - start, piece))
                    size += len(piece)
            if len(seen) > 300_000:
                seen.clear()
            if size > 4_000_000 or len(rows) > 50_000:
                yield _batch(rows)
                rows, size = [], 0
    if rows:
        yield _batch(rows)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, left, piece, doc, digest and start: the repeated stretches."""
    anchor, same, place, group, block, size, out = None, None, None, [], [], 0, []
    half = (LENGTH - GRAM) // 2

    def close() -> None:
        """Equal strings around an anchor go on for ``half`` bytes to the left or to the right of it, so others need no sorting."""
        nonlocal size
        if len(group) > 1:
            sides = [(piece[left - half : left] if left >= half else None, piece[left + GRAM : left + GRAM + half] if len(piece) >= left + GRAM + half else None) for _, _, _, piece, left in group]
            before, after = Counter(x for x, _ in sides), Counter(y for _, y in sides)
            for (doc, digest, start, piece, _), (x, y) in zip(group, sides, strict=True):
                if x is not None and before[x] > 1 or y is not None and after[y] > 1:
                    block.append((doc, digest, start, piece))
                    size += len(piece)
        group.clear()

    def solve() -> None:
        nonlocal size
        number = {x: k for k, x in enumerate(sorted({b[:2] for b in block}))}
        for (doc, digest, start, _), found in zip(block, repeats([b[3] for b in block], [(number[b[:2]], b[2]) for b in block]), strict=True):
            out.extend((doc, digest, start + lo, start + hi) for lo, hi in found)
        block.clear()
        size = 0

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["doc", "digest", "start", "stop"])

    for batch in batches:
        for doc, digest, start, stop, a, left, piece in zip(*(batch.column(c).to_pylist() for c in ("doc", "digest", "start", "stop", "anchor", "left", "piece")), strict=True):
            if a != anchor:
                close()
                if size > BLOCK_BYTES:
                    solve()
                anchor, same = a, None
            if (left, piece) != same:
                same, place = (left, piece), (doc, digest, start)
                group.append((*place, piece, left))
            elif (doc, digest, start) != place:  # later; the same place may come from several rows
                out.append((doc, digest, start, stop))
        if len(out) > 50_000:
            yield flush()
    close()
    if block:
        solve()
    yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for doc, text, whole, stretches in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "whole", "stretches")), strict=True):
            data = (text or "").encode()
            spans: list[list[int]] = []
            for lo, hi in [(0, len(data))] if whole else sorted((s["start"], s["stop"]) for s in stretches or ()):
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
            digest, at = hashlib.sha256(), 0
            for lo, hi in spans:
                digest.update(data[at:lo])
                at = hi
            digest.update(data[at:])
            rows.append((doc, len(data), sum(hi - lo for lo, hi in spans), len(spans), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (*[pa.int64()] * 4, pa.string()), strict=True)], names=names)


def _place(docs: DataFrame, doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63)))


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, doc, digest, text: null ids come first, null texts are empty; ``doc`` and ``digest`` together are a document."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))
    return rows.select("doc_id", _place(rows, "doc_id").alias("doc"), digest.alias("digest"), "text")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, digest) of documents that equal an earlier one, and (doc, digest, stretches) of others with repeats, as :func:`_documents` names them."""
    spark, document = docs.sparkSession, ["doc", "digest"]
    long = _documents(docs, doc_id, text).where(F.octet_length("text") >= LENGTH).drop("doc_id")
    narrow = materialize(long.select(*document), "digests")
    firsts = narrow.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = narrow.join(firsts, "digest")
    whole = materialize(copies.where("doc > first").select(*document).distinct(), "whole")
    twins = materialize(copies.where("doc = first").groupBy(*document).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "twins")
    listed = materialize(long.mapInArrow(_list_anchors, "doc long, digest binary, anchors array<bigint>"), "anchors")
    maybe, clear = sieve(listed, F.col("doc"), whole.select("doc").unionAll(twins.select("doc")))
    singles = maybe.join(whole, document, "left_anti")
    if not twins.isEmpty():
        singles = singles.join(twins, document, "left_anti").unionByName(singles.join(twins, document, "left_semi").dropDuplicates(document))
    singles = clear.unionByName(singles)
    # anchors are gathered by a hash of the document: if two share one, both only look at more anchors
    each = singles.select(F.xxhash64(*document).alias("key"), F.explode("anchors").alias("anchor"))
    often = materialize(each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "often")
    release(spark)
    wanted = materialize(each.join(often, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("wanted")), "wanted")
    release(spark)
    keyed = long.withColumn("key", F.xxhash64(*document))
    around = materialize(sieve(keyed, F.col("key"), wanted.select("key"))[0].join(wanted, "key").mapInArrow(_surround, _ROUND), "around")
    release(spark)
    pieces = around.where("anchor is not null")
    compared = pieces.repartition("anchor").sortWithinPartitions("anchor", "left", "piece", "doc", "digest", "start").mapInArrow(_compare, "doc long, digest binary, start int, stop int")
    known = around.where("anchor is null").select(*document, "start", "stop")
    stretches = materialize(compared.unionAll(known).groupBy(*document).agg(F.collect_set(F.struct("start", "stop")).alias("stretches")), "stretches")
    for used in (narrow, twins, listed, often, wanted, around):
        drop_materialized(used)
    release(spark)
    return whole, stretches


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256. An empty table gives no rows."""
    whole, stretches = spans(docs, doc_id, text)
    # texts are only shuffled if their id may be one of a document with repeats
    some, clear = sieve(docs, _place(docs, doc_id), whole.select("doc").unionAll(stretches.select("doc")))
    marked = _documents(some, doc_id, text).join(whole.withColumn("whole", F.lit(True)), ["doc", "digest"], "left").join(stretches, ["doc", "digest"], "left")
    marked = marked.select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "stretches")
    others = _documents(clear, doc_id, text).select("doc_id", "text", F.lit(False).alias("whole"), F.lit(None).cast(marked.schema["stretches"].dataType).alias("stretches"))
    return marked.unionAll(others).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
