"""Exact n-gram Jaccard self-join with set-relation skipping; documents linked at a threshold form components.

1. Each document becomes its set of hashed shingles. Equal sets form one class; only classes go on.
2. Which sets may be linked at all: a set is listed under its smallest tokens, more of them than two linked sets can differ in, so that linked sets share
   several lists; it is known for each set how many at least. A task meets its own sets first and sends one entry for each list and size block, so a token
   that everything has is no hot key. Of a list only sets of one size block, or of two next to each other, meet. Sets that meet others in too few lists are left out.
3. With which: a set that is left is cut by hash position into somewhat more parts than two linked sets of its size can differ in. Index lists are kept by
   size block and position of the part: a list is only met by sets of its own block and the one below, all others are skipped unread.
   Sets in too few shared lists are left out. Each list links the others to its smallest one, and the components of these links are verified.
4. Verification, in tiles of at most ``BLOCK`` x ``BLOCK`` classes of one component and of size blocks that can match: inverted lists ordered by set size.
   A set that meets nothing in the lists of its rarest tokens stops there; each of these lists holds only sets that have the token among their own rarest,
   and is read as far as the position of the token in the set allows. The overlaps
   of a set that is like the one before it are derived from that one's overlaps by the lists of the tokens in which they differ.
   A tile gives back spanning links and link counts, never its pairs.

Shingles and classes have 64-bit hashes: among n different sets some two collide with odds of n^2 / 2^65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewright.llm.components import components
from slicewright.llm.sieve import sieve
from slicewright.llm.textcols import free_name
from slicewright.session import drop_materialized, materialize, release

#: Words of a shingle, and the threshold: linked if 100 * intersection >= THRESHOLD * union.
WORDS, THRESHOLD = 5, 80
BLOCK = 512
#: One token of so many is listed beyond what linked sets can differ in; more entries then, but fewer sets that share enough lists by chance.
SPARE = 10
#: List entries that a task holds at once.
HELD = 1_000_000
#: How often classes in too few shared lists of parts are left out; any number gives the same links.
ROUNDS = 1
CACHE_WORDS = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Whole texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mixed(out * _ODD + h[k : len(h) - n + 1 + k])
        return np.unique(out)


def size_blocks(most: int, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(least, largest) size of each block; linked sets are in one block or in neighbouring ones."""
    blocks, low = [], 1
    while low <= most:
        high = max(low, 100 * low // threshold)
        blocks.append((low, high))
        low = high + 1
    return blocks


@cache
def _blocks(threshold: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The blocks of all sizes, and the least size of each."""
    blocks = size_blocks(1 << 40, threshold)
    return blocks, np.array([low for low, _ in blocks])


def size_block(n: int, threshold: int = THRESHOLD) -> int:
    """The number of the block of sets of size ``n``."""
    return int(np.searchsorted(_blocks(threshold)[1], n, side="right")) - 1


def signatures(tokens: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, int]:
    """The lists that a set is in, which are its smallest tokens, and how many of them a linked set is in too.

    Linked sets have at least the threshold's share of the larger one in common. So if each is listed under as many tokens as it may have alone, and ``k`` more,
    ``k`` lists are common to both, with the ``k`` of the smaller one.
    """
    n = len(tokens)
    common = -(-threshold * n // 100)
    return tokens[: n - common + max(1, n // SPARE)], max(1, common // SPARE)


def differing(high: int, threshold: int = THRESHOLD) -> int:
    """How many tokens at most two linked sets of sizes up to ``high`` have not in common."""
    return 2 * high * (100 - threshold) // (100 + threshold)


def part_lists(tokens: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, int, int, int]:
    """The index lists that a set is in, how many of them are of its own block, and how many of its own and of the next block a linked set has too.

    A list is a hash of size block, position and content of a part. Two sets that are linked differ in at most as many parts as in tokens, so a set
    with fewer empty parts than must be equal need not list those: what is left of the equal ones has content.
    """
    if not len(tokens):
        return np.zeros(0, np.int64), 0, 1, 1
    blocks, lows = _blocks(threshold)
    n = len(tokens)
    own, out, needs = int(np.searchsorted(lows, n, side="right")) - 1, [], []
    mixed = _mixed(tokens)
    for block in (own, own + 1):
        high = blocks[block][1]
        most = differing(high, threshold)
        if not most:  # only equal sets are linked at such sizes
            out.append(np.zeros(0, np.uint64))
            needs.append(1)
            continue
        parts = most + 2 + most // 8
        place = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ascending, as the tokens are
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        sums, at = np.add.reduceat(mixed, starts), place[starts]
        empty = parts - len(at)
        equal = parts - (n + min(100 * n // threshold, high)) * (100 - threshold) // (100 + threshold)  # parts at least
        if empty >= equal:
            gaps = np.setdiff1d(np.arange(parts, dtype=np.uint64), at)
            sums, at = np.concatenate([sums, np.zeros(len(gaps), np.uint64)]), np.concatenate([at, gaps])
        needs.append(max(1, equal - empty))
        out.append(_mixed(sums ^ _mixed(at + np.uint64(block << 32))))
    return np.concatenate(out).view(np.int64), len(out[0]), *needs


def class_of(tokens: np.ndarray) -> int | None:
    """The class of a set, None for the empty one."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def meet_at_home(lists: list[np.ndarray], blocks: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each set of a task the lists for which it speaks, one set for each list and size block, and the lists that another set of the task is in too,
    one of its own size block or of one beside it."""
    if not lists:
        return []
    sizes = [len(x) for x in lists]
    flat, block = np.concatenate(lists), np.repeat(np.array(blocks, np.int16), sizes)
    order = np.argsort(block, kind="stable")
    order = order[np.argsort(flat[order], kind="stable")]
    same, step = flat[order][1:] == flat[order][:-1], np.diff(block[order])
    beside = same & (step <= 1)
    speaks, met = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    speaks[order] = np.append(True, ~same | (step > 0))[: len(flat)]
    met[order] = (np.append(False, beside) | np.append(beside, False))[: len(flat)]
    cuts = np.cumsum(sizes)[:-1]
    return [(x[s], x[m]) for x, s, m in zip(lists, np.split(speaks, cuts), np.split(met, cuts), strict=True)]


_SETS = "doc_id long, digest long, n long, class long, block int, need int, lists array<bigint>, met array<bigint>"


def _describe(words: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``_SETS``: ``lists`` and ``met`` only where a task comes to a class for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, rows, lists, held = Shingler(words), set(), [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            found = iter(meet_at_home([x for x in lists if x is not None], [r[4] for r, x in zip(rows, lists, strict=True) if x is not None]))
            both = [(None, None) if x is None else next(found) for x in lists]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            arrays += [pa.array([None if x[k] is None else x[k].view(np.int64) for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            rows.clear()
            lists.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "digest", "n", "class", "block", "need", "lists", "met"])

        for batch in batches:
            for doc_id, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text")), strict=True):
                tokens = shingler(text)
                cls = class_of(tokens)
                new = cls is not None and cls not in seen
                if new:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(cls)
                listed, need = signatures(tokens, threshold) if new else (None, None)
                rows.append((doc_id, digest, len(tokens), cls, size_block(len(tokens), threshold) if cls is not None else None, need))
                lists.append(listed)
                held += len(listed) if new else 0
                if held > HELD or len(rows) > HELD // 10:
                    yield flush()
        yield flush()

    return run


def _links(sets: list[np.ndarray], sides: list[int], cross: bool, weights: list[int], threshold: int = THRESHOLD) -> tuple[list[tuple[int, int]], list[int]]:
    """(spanning links, weight of the links of each set). ``sets`` ascend in size; with ``cross``, only pairs of different sides count."""
    count, sizes = len(sets), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]  # the rarest is 0
    owner = np.repeat(np.arange(count), sizes)
    order = np.lexsort((token, owner))
    token = token[order]  # each set from its rarest token on
    ends = np.cumsum(sizes)
    own = [token[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    alone = sizes - -(-threshold * sizes // 100)  # tokens that a set may have alone
    position = np.arange(len(token)) - np.repeat(ends - sizes, sizes)
    entries = token * count + owner
    heads = np.sort(entries[position <= np.repeat(alone, sizes)])  # entries of tokens that are among the rarest of their set
    places = np.sort(entries)
    lists = places % count  # set numbers, by token, ascending in size
    side, weight = np.array(sides), np.array(weights)
    parent = list(range(count))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def meet(tokens: np.ndarray, low: int, high: int) -> np.ndarray:
        """How often each set from ``low`` to below ``high`` is in the lists of ``tokens``, of which only that stretch is read."""
        begin = np.searchsorted(places, tokens * count + low)
        n = np.searchsorted(places, tokens * count + high) - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(lists[at], minlength=count)

    def may_link(a: int, tokens: np.ndarray) -> bool:
        """Whether a set after ``a`` is in a list of its rarest tokens, each read as far as what is left of ``tokens`` from its position on can match."""
        n = len(tokens)
        rare = tokens[: int(alone[a]) + 1]
        most = (100 + threshold) * (n - np.arange(len(rare))) // threshold - n
        upto = np.searchsorted(sizes, most, side="right")
        return bool((np.searchsorted(heads, rare * count + np.maximum(upto, a + 1)) > np.searchsorted(heads, rare * count + a + 1)).any())

    spanning, linked = [], [0] * count
    before: tuple[np.ndarray, np.ndarray, int] | None = None  # tokens and overlaps of the last set that was computed, and up to where
    for a in range(count):
        n, tokens = int(sizes[a]), own[a]
        high = int(np.searchsorted(sizes, 100 * n // threshold, side="right"))  # sets from a on that are not too large
        if high <= a + 1:
            continue
        derived = False
        if before is not None and before[2] > a + 1:
            gone, new = np.setdiff1d(before[0], tokens, assume_unique=True), np.setdiff1d(tokens, before[0], assume_unique=True)
            derived = 2 * (len(gone) + len(new)) < n
        if derived:
            overlap = before[1].copy()
            if len(gone):
                overlap -= meet(gone, a + 1, before[2])
            if len(new):
                overlap += meet(new, a + 1, before[2])
            if high > before[2]:
                overlap += meet(tokens, before[2], high)
        else:
            if not may_link(a, tokens):
                continue
            overlap = meet(tokens, a + 1, high)
        before = tokens, overlap, high
        near = overlap[a + 1 : high]
        hits = a + 1 + np.flatnonzero((100 + threshold) * near >= threshold * (n + sizes[a + 1 : high]))
        if cross:
            hits = hits[side[hits] != side[a]]
        for b in hits.tolist():
            linked[a] += int(weight[b])
            linked[b] += int(weight[a])
            x, y = find(a), find(b)
            if x != y:
                parent[x] = y
                spanning.append((a, b))
    return spanning, linked


def _tiles(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by tile: each tile's links (a, b) and weights of links (a, null, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, out = None, {}, []

        def finish() -> None:
            members = sorted(rows.items(), key=lambda x: (len(x[1][0]), x[1][0].tobytes()))
            if len(members) > 1:
                spanning, linked = _links([m[1][0] for m in members], [m[1][1] for m in members], tile[1] != tile[2], [m[1][2] for m in members], threshold)
                out.extend((members[a][0], members[b][0], 0) for a, b in spanning)
                out.extend((members[a][0], None, w) for a, w in enumerate(linked) if w)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "w"])

        for batch in batches:
            for comp, i, j, cls, block, copies, data in zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j", "class", "block", "copies", "tokens")), strict=True):
                if (comp, i, j) != tile:
                    if tile:
                        finish()
                    tile, rows = (comp, i, j), {}
                rows[cls] = (np.frombuffer(data, np.uint64), block, copies)
            if len(out) > 50_000:
                yield flush()
        if tile:
            finish()
        yield flush()

    return run


_TOKENS = "class long, copies long, size int, tokens binary, lists array<bigint>, own int, need_own int, need_next int"


def _tokens(words: int, threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``_TOKENS`` for the texts of classes, each class once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(words), set()
        for batch in batches:
            sets, found, right = [], [], []
            for text, c in zip(batch.column("text").to_pylist(), batch.column("class").to_pylist(), strict=True):
                tokens = None if c in seen else shingler(text)
                right.append(tokens is not None and class_of(tokens) == c)  # digests of an id's texts may be equal by chance
                if right[-1]:
                    sets.append(tokens.tobytes())
                    found.append(part_lists(tokens, threshold))
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(c)
            left = batch.drop_columns(["text"]).filter(pa.array(right, pa.bool_()))
            lists = pa.array([x[0] for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(sets, pa.binary()), lists, *(pa.array([x[k] for x in found], pa.int32()) for k in (1, 2, 3))], names=["class", "copies", "size", "tokens", "lists", "own", "need_own", "need_next"])

    return run


def _meetings(listed: DataFrame) -> DataFrame:
    """(class, c): in how many of its lists a class meets another one of its own size block or of one beside it, if in any."""
    by_list = Window.partitionBy("list").orderBy("block", "class")
    sent = listed.select(F.explode("lists").alias("list"), "class", "block")
    # those of a list are in the order of their blocks, so who meets any meets the one before or after; of a class that several tasks sent, one entry is beside another class
    for name, near in (("before", F.lag), ("after", F.lead)):
        sent = sent.withColumn(name, (near("class").over(by_list) != F.col("class")) & (F.abs(near("block").over(by_list) - F.col("block")) <= 1))
    met = sent.where("before or after").select("list", "class").unionByName(listed.select(F.explode("met").alias("list"), "class"))
    return met.repartition("class").dropDuplicates(["class", "list"]).groupBy("class").agg(F.count(F.lit(1)).alias("c"))


def _edges(hits: DataFrame) -> DataFrame:
    """Edges (a, b) from each shared list's smallest class to the others, without classes that are in too few shared lists of a block to be linked with any.

    ``hits`` is a written table of (list, class, next, need), which goes.
    """
    for _ in range(ROUNDS):
        several = hits.groupBy("list").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("list")
        met = hits.join(several, "list")
        enough = met.groupBy("class", "next").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need")).where("c >= need").select("class", "next")
        left = materialize(met.join(enough, ["class", "next"], "left_semi"), "hits")
        drop_materialized(hits)
        hits = left
    lows = hits.groupBy("list").agg(F.min("class").alias("a"))
    edges = materialize(hits.join(lows, "list").where("a < class").select("a", F.col("class").alias("b")).distinct(), "met")
    drop_materialized(hits)
    return edges


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.withColumn("digest", F.xxhash64("text"))


def _classes(docs: DataFrame, doc_id: str, text: str, words: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n, class, ...) for each row, and (class, component_id, n_links, first, digest, stays) for each class: ``first`` and ``digest``, of a text,
    are of the class's row with the smallest id, null ids last, and the class with the smallest such row of its component stays."""
    if words < 1 or not 1 <= threshold <= 99:
        raise ValueError("words must be positive, and the threshold from 1 to 99")
    spark = docs.sparkSession
    release(spark)
    rows = _rows(docs, doc_id, text)
    described = materialize(rows.mapInArrow(_describe(words, threshold), _SETS), "sets")
    met = materialize(_meetings(described.where("lists is not null")), "met")
    release(spark)
    lowest_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("low")
    classes = described.where("class is not null").groupBy("class").agg(lowest_row, F.count(F.lit(1)).alias("copies"), F.first("block").alias("size"), F.max("need").alias("need"))
    classes = materialize(classes.select("class", F.col("low.doc_id").alias("first"), F.col("low.digest").alias("digest"), "copies", "size", "need"), "classes")
    likely = materialize(classes.join(met, "class").where("c >= need").select("class", "first", F.col("digest").alias("of"), "copies", "size"), "likely")
    texts = sieve(rows, F.col("doc_id"), likely.select("first"))[0].join(likely, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("of"))).select("text", "class", "copies", "size")
    sets = materialize(texts.mapInArrow(_tokens(words, threshold), _TOKENS), "tokens")
    release(spark)
    listed = sets.select(F.posexplode("lists").alias("at", "list"), "class", "own", "need_own", "need_next").withColumn("next", F.col("at") >= F.col("own"))
    hits = materialize(listed.select("list", "class", "next", F.when(F.col("next"), F.col("need_next")).otherwise(F.col("need_own")).alias("need")).distinct(), "hits")
    edges = _edges(hits)
    release(spark)
    near = materialize(components(edges), "near")
    drop_materialized(edges)
    release(spark)
    members = sets.select("class", "size").distinct().join(near, near["node"] == sets["class"]).select("class", "size", F.col("root").alias("comp"))
    sized = members.groupBy("comp", "size").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sized = sized.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("size", "blocks"))).alias("sizes"))  # as many as there are size blocks: under 200
    at = lambda size, k: F.shiftleft(size.cast("long"), 32) + k
    matching = F.filter(F.sequence(F.col("size") - 1, F.col("size") + 1), lambda s: F.map_contains_key("sizes", s))
    others = F.flatten(F.transform(matching, lambda s: F.transform(F.sequence(F.lit(0), F.col("sizes")[s] - 1), lambda k: at(s, k))))
    block = at(F.col("size"), F.pmod(F.xxhash64("class"), F.col("sizes")[F.col("size")]))
    dealt = members.join(sized, "comp").select("class", "comp", block.alias("block"), others.alias("others"))
    # tokens are only shuffled for sets that have a place, first to it and then to its tiles
    placed = sieve(sets.select("class", "copies", "tokens"), F.col("class"), near.select("node"))[0].join(dealt, "class").withColumn("other", F.explode("others"))
    tiled = placed.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "block", "copies", "tokens")
    verified = materialize(tiled.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_tiles(threshold), "a long, b long, w long"), "links")
    release(spark)
    roots = components(verified.where("b is not null").select("a", "b"))
    weights = verified.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("w").alias("w"))
    known = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").join(weights, "class", "left")
    named = known.select("class", F.coalesce("root", "class").alias("root"), "first", "digest", (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest", "class")).alias("low"))
    by_class = named.join(lowest, "root").select("class", "component_id", "n_links", "first", "digest", (F.col("low.class") == F.col("class")).alias("stays"))
    by_class = materialize(by_class, "by_class")
    for used in (met, likely, classes, sets, near, verified):
        drop_materialized(used)
    return described, by_class


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links), n_links (other rows it is linked with).

    Sets are of distinct shingles of ``words`` words; two are linked if 100 * intersection >= ``threshold`` * union, with a threshold from 1 to 99.
    Null and empty texts have an empty set and are linked with nothing. Null ids are never smallest: rows without an id have their component's, or null.
    Repeated rows are linked, as equal sets are. Other columns are not read; an empty table gives no rows.
    """
    described, by_class = _classes(docs, doc_id, text, words, threshold)
    out = described.select("doc_id", "n", "class").join(by_class, "class", "left")
    result = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "joined")
    for used in (described, by_class):
        drop_materialized(used)
    return result.withColumnRenamed("doc_id", doc_id)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, whole and with their own columns: of each component one row, with the smallest id, a null one only if there is no other.

    Of several texts that a component has under that id the one with the smallest hash stays. Rows with an empty set stay; of rows that repeat an id and its text, once.
    """
    described, by_class = _classes(docs, doc_id, text, words, threshold)
    first = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("of"))
    named = described.select("doc_id", "digest", "class").join(by_class.withColumnRenamed("digest", "of"), "class", "left")
    goes = F.when(F.col("class").isNotNull(), ~first).otherwise(F.lit(False))
    decided = materialize(named.groupBy("doc_id", "digest").agg(F.max(goes).alias("goes"), F.count(F.lit(1)).alias("c")).where("goes or c > 1"), "decided")
    for used in (described, by_class):
        drop_materialized(used)
    given, hashed = free_name(docs, "id"), free_name(docs, "hash")
    # texts are only shuffled if their id may be one of these
    some, clear = sieve(docs, F.col(f"`{doc_id}`").cast("long"), decided.select("doc_id"))
    rows = some.withColumns({given: F.col(f"`{doc_id}`").cast("long"), hashed: F.xxhash64(F.col(f"`{text}`").cast("string"))})
    same = lambda table: F.col(given).eqNullSafe(table["doc_id"]) & (F.col(hashed) == table["digest"])
    odd, again = decided.select("doc_id", "digest"), decided.where("not goes").select("doc_id", "digest")
    kept = clear.unionAll(rows.join(odd, same(odd), "left_anti").drop(given, hashed))
    if again.isEmpty():
        return kept
    # of repeated rows one stays: the partial limit of each task goes before the shuffle
    repeated, rank = rows.join(again, same(again), "left_semi"), free_name(docs, "rank")
    order = F.row_number().over(Window.partitionBy(given, hashed).orderBy(F.lit(0)))
    return kept.unionAll(repeated.withColumn(rank, order).where(F.col(rank) == 1).drop(given, hashed, rank))
