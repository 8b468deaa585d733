"""Token ids in a content-addressed store.

Format, as tables that Spark reads from any file system:

* ``<name>``: bucketed by key, rows of two kinds. ``chunk`` rows hold a piece of a document's id stream under the
  blake2b-128 of its bytes (ids as little-endian uint16, or uint32 for vocabularies above 65,536), each stored once.
  A rolling sum over the last ``WINDOW`` mixed ids decides the cuts, so equal passages give equal chunks wherever they stand.
* recipes, in ascending doc_id order: doc_id, start (ids of all documents before), n_tokens, crc32, the digests of the
  chunks, and the Merkle root of the block of recipes that it is in.
* manifest: a root per part of the recipes, and one root over the parts.

Reading looks each digest up, checks every chunk against its address, every document against its crc32 and the recipes against the manifest.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewright.session import drop_materialized, materialize, release, small_batches

END_ID = 0
WINDOW, AVERAGE, LEAST, MOST = 16, 512, 128, 4096
#: Entries of a worker's word cache, a bound on its memory: of two halves the older one goes when the newer one is full.
CACHE_WORDS = 1_600_000
#: New words that are encoded as one text; the tokenizer's time for a word grows with the length of the text that it is in.
JOINED = 200
#: Characters of the texts whose words are numbered together; a longer text is a group of its own.
GROUP_CHARS = 8_000_000

_STREAM = "kind string, key binary, doc_id long, n_tokens long, ids_crc32 long, digests array<binary>, payload binary"
_PLACED = "doc_id long, local_start long, n_tokens long, ids_crc32 long, digests array<binary>, part int, block int, block_root binary"
_OTHER_SPACE = [c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n"]


def single_spaced(text: str) -> bool:
    """Whether each space of a text has other than white space on both sides (tabs and the like are not looked into)."""
    return not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or "\0" in text or any(c in text for c in _OTHER_SPACE))


class Encoder:
    """Encodes texts, each distinct space-led word once while it stays in the cache.

    The byte-level pattern never joins a word to the single space that follows it, so a text without other white
    space beside a space can be cut before each space; other texts are encoded whole, and so are texts with the content of an
    added token, such as <|endoftext|>, which the tokenizer matches before anything else. A group of texts is cut and its words are numbered by
    Arrow; only distinct words are looked up, and the ids are put together by their numbers. New words are encoded ``JOINED`` at a time:
    only the first token of a space-led word starts with the vocabulary's sign for a space, which tells the words apart again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.words: dict[str, bytes] = {}  # ids of the words, each with a space before it
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _has_added(self, text: str) -> bool:
        return any(content in text for content in self.added)

    def _learn(self, new: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(new), JOINED):
            words = new[at : at + JOINED]
            joined = " " + " ".join(words)
            if self._has_added(joined):  # an added token with a space in it, over two words that no text has side by side
                out += self._whole([" " + w for w in words])
                continue
            data = self._whole([joined])[0]
            ends = [*(4 * np.flatnonzero(self.leads[np.frombuffer(data, "<u4")])[1:]).tolist(), len(data)]
            if len(ends) != len(words):
                raise ValueError("words do not come apart: the vocabulary is not byte-level")
            out += [data[x:y] for x, y in zip([0, *ends], ends)]
        return out

    def _led(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words with a space before each."""
        if 2 * len(self.words) > CACHE_WORDS:
            self.old, self.words = self.words, {}
        found = list(map(self.words.get, words))
        lacking = [k for k, ids in enumerate(found) if ids is None]
        if self.old:
            for k in lacking:
                found[k] = ids = self.old.get(words[k])
                if ids is not None:
                    self.words[words[k]] = ids
            lacking = [k for k in lacking if found[k] is None]
        new = [words[k] for k in lacking]
        learnt = self._learn(new)
        self.words.update(zip(new, learnt, strict=True))
        for k, ids in zip(lacking, learnt, strict=True):
            found[k] = ids
        return found

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of single-spaced texts."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        starts, coded = lists.offsets.to_numpy().astype(np.int64), lists.flatten().dictionary_encode()
        word = coded.indices.to_numpy()
        led = np.ones(len(word), bool)
        led[starts[:-1]] = False  # the first word of a text has no space before it
        used = np.zeros(len(coded.dictionary), bool)
        used[word[led]] = True
        parts = self._led(coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        number = np.cumsum(used, dtype=np.int32) - 1
        word = number[word]
        word[starts[:-1]] = len(parts) + np.arange(len(texts))
        parts += self._whole([t.partition(" ")[0] for t in texts])
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        n = size[word]
        before = np.zeros(len(n) + 1, np.int32)  # a group has far fewer than 2^31 ids
        np.cumsum(n, out=before[1:])
        begin = (np.cumsum(size, dtype=np.int32) - size)[word] - before[:-1]
        at = np.repeat(begin, n)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(b"".join(parts), "<u4")[at]
        ends = before[starts].tolist()
        return [ids[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(texts)
        group, chars = [], 0

        def finish() -> None:
            for k, ids in zip(group, self._by_words([texts[k] for k in group]), strict=True):
                out[k] = ids
            group.clear()

        for k, text in enumerate(texts):
            if not single_spaced(text) or self._has_added(text):
                out[k] = self._whole([text])[0]
                continue
            if group and chars + len(text) > GROUP_CHARS:
                finish()
                chars = 0
            group.append(k)
            chars += len(text)
        if group:
            finish()
        return out


@lru_cache(maxsize=1)
def _worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process. It only remembers what words encode to, so nothing depends on the tasks before."""
    return Encoder(path)


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of one id stream; the last is its length."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    rolled = np.cumsum(mixed)
    rolled[WINDOW:] -= rolled[:-WINDOW].copy()
    hits = np.flatnonzero((rolled * np.uint64(0x94D049BB133111EB)) >> np.uint64(32) < np.uint64((1 << 32) // AVERAGE)) + 1
    ends, last = [], 0
    for hit in [*hits.tolist(), n]:
        while hit - last > MOST:
            last += MOST
            ends.append(last)
        if hit - last >= LEAST or hit == n and hit > last:
            ends.append(hit)
            last = hit
    return ends


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _stream(tokenizer_path: str, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, count, part = _worker_encoder(tokenizer_path), set(), 0, TaskContext.get().partitionId()
        schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("digests", pa.list_(pa.binary())), ("payload", pa.binary())])
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                rows = []
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode([t or "" for t in piece.column(1).to_pylist()]), strict=True):
                    ids += end
                    stored, last, digests = np.frombuffer(ids, "<u4"), 0, []
                    ends = cuts(stored)
                    stored = stored if wide else stored.astype("<u2")
                    for stop in ends:
                        data = stored[last:stop].tobytes()
                        digests.append(_digest(data))
                        if digests[-1] not in seen:  # what this task has sent need not be sent again
                            if len(seen) >= 1_000_000:
                                seen.clear()
                            seen.add(digests[-1])
                            rows.append(("chunk", digests[-1], None, None, None, None, data))
                        last = stop
                    rows.append(("recipe", struct.pack("<qq", part, count), doc_id, len(ids) // 4, zlib.crc32(ids), digests, None))
                    count += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running starts inside a part, and a Merkle root for each batch of recipes."""
    part, before = TaskContext.get().partitionId(), 0
    for block, batch in enumerate(batches):
        n = np.array(batch.column("n_tokens").to_pylist(), "int64")
        root = merkle([_digest(b"".join(x)) for x in batch.column("digests").to_pylist()])
        starts = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(starts), batch.column("n_tokens"), batch.column("ids_crc32"), batch.column("digests"), pa.array([part] * len(n), pa.int32()), pa.array([block] * len(n), pa.int32()), pa.array([root] * len(n), pa.binary())],
            names=["doc_id", "local_start", "n_tokens", "ids_crc32", "digests", "part", "block", "block_root"],
        )


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree over digests; an odd one out moves up as it is."""
    while len(leaves) > 1:
        leaves = [_digest(b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else _digest(b"")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """A root per part: sha256 over its block roots in order."""
    blocks = recipes.groupBy("part", "block").agg(F.first("block_root").alias("root"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", F.hex("root").alias("root")))), lambda x: x["root"]), "")
    return blocks.groupBy("part").agg(F.sha2(ordered.cast("binary"), 256).alias("root"))


@dataclass
class Store:
    """Where a written store is: the chunk table's name, the recipes, and the manifest's root."""

    name: str
    recipes: DataFrame
    root: str
    wide: bool

    def drop(self) -> None:
        self.recipes.sparkSession.sql(f"drop table if exists {self.name}")
        drop_materialized(self.recipes)


def _root(recipes: DataFrame) -> str:
    parts = sorted((r["part"], r["root"]) for r in _part_roots(recipes).collect())  # a row per part of the recipes
    return hashlib.sha256("".join(root for _, root in parts).encode()).hexdigest()


def write(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", wide: bool = False, buckets: int | None = None) -> Store:
    """Encode whole texts, end each with ``END_ID`` and store them; null text is empty, null ids come first, repeated rows are stored each with a recipe of its own."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"token_store_{uuid.uuid4().hex[:12]}"
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_stream(tokenizer_path, wide), _STREAM)
    with small_batches(spark):
        # one file a bucket for both kinds: each file that an executor makes starts a process or two, which for a moment count its memory twice
        rows.repartition("key").dropDuplicates(["key"]).write.bucketBy(buckets, "key").option("compression", "zstd").saveAsTable(name)
    release(spark)
    recipes = spark.table(name).where("kind = 'recipe'").select("doc_id", "n_tokens", "ids_crc32", "digests", "key")
    ordered = recipes.repartitionByRange("doc_id", "n_tokens", "ids_crc32", "key").sortWithinPartitions("doc_id", "n_tokens", "ids_crc32", "key")
    placed = materialize(ordered.drop("key").mapInArrow(_place, _PLACED), "recipes")
    totals = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row per part
    offsets, before = [], 0
    for part, n in totals:
        offsets.append((part, before))
        before += n
    values = ", ".join(f"({part}, {at}L)" for part, at in offsets) or "(-1, 0L)"
    starts = F.broadcast(spark.sql(f"select * from values {values} as t(part, before)"))  # a row per part
    final = materialize(placed.join(starts, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start"), "placed")
    drop_materialized(placed)
    return Store(name, final, _root(final), wide)


def _assemble(wide: bool, with_ids: bool):
    kind = "<u4" if wide else "<u2"

    def finish(head: tuple, data: list[bytes]) -> tuple:
        start, doc_id, n, crc = head
        ids = np.frombuffer(b"".join(data), kind).astype("<u4").tobytes()
        found = len(ids) // 4, zlib.crc32(ids)
        if found != (n, crc):
            raise ValueError(f"document {doc_id} at {start} does not match its recipe")
        return (doc_id, start, *found, ids)[: 4 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, data, done, size = None, [], [], 0
        fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
        schema = pa.schema(fields if with_ids else fields[:-1])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for *own, digest, payload in zip(*(batch.column(c).to_pylist() for c in ("start", "doc_id", "n_tokens", "ids_crc32", "digest", "payload")), strict=True):
                if payload is None or _digest(payload) != digest:
                    raise ValueError(f"chunk {digest.hex()} is missing or does not match its address")
                if head and own[0] != head[0]:
                    done.append(finish(head, data))
                    size += len(done[-1][-1]) if with_ids else 40
                    data = []
                    if size > 8_000_000:
                        yield flush()
                        done, size = [], 0
                head = tuple(own)
                data.append(payload)
        if head:
            done.append(finish(head, data))
        if done:
            yield flush()

    return run


def read(store: Store, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (uint32 little-endian bytes), rebuilt from the stored chunks and verified; without the last column if ``ids`` is false."""
    spark = store.recipes.sparkSession
    if _root(store.recipes) != store.root:
        raise ValueError("the recipes do not match the manifest")
    refs = store.recipes.select("start", "doc_id", "n_tokens", "ids_crc32", F.posexplode("digests").alias("ix", "digest"))
    chunks = spark.table(store.name).where("kind = 'chunk'").select(F.col("key"), "payload")
    whole = refs.join(chunks, refs["digest"] == chunks["key"], "left").select("start", "ix", "doc_id", "n_tokens", "ids_crc32", "digest", "payload")
    return whole.repartition("start").sortWithinPartitions("start", "ix").mapInArrow(_assemble(store.wide, ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
