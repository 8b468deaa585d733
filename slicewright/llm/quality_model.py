"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training bins each statistic by quantiles, grows each level of each tree from gradient histograms, and lays the trees out as flat
complete arrays (feature, threshold, leaf). Scoring walks all rows of a batch down all trees with numpy indexing, ``depth`` steps in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.llm.textcols import crc_mod, free_name

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 12_000
#: Characters that a text which is learnt from has at most; all texts are scored, whatever their length.
LONGEST = 30_000
KEEP_AT = 0.7

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
FEATURES = "log_words log_bytes word_bytes upper lower digit symbol stop comma shout other_ascii high newline distinct bigrams repeated dup_lines line_words longest first_caps".split()


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``; null counts as empty."""
    data = (text or "").encode()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, size = len(words), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(map(eq, words, words[1:]))
    share = lambda *ranges: float(sum(count[a:b].sum() for a, b in ranges)) / size
    return [
        np.log1p(n), np.log1p(len(data)), size / max(1, n), share((65, 91)), share((97, 123)), share((48, 58)), float(count[_SYMBOLS].sum()) / max(1, n),
        float(count[46]) / max(1, n), float(count[44]) / max(1, n), float(count[33]) / max(1, n), share((34, 48), (58, 65), (91, 97)), share((128, 256)), float(count[10]) / max(1, n),
        len(set(words)) / max(1, n), len(set(zip(words, words[1:]))) / max(1, n - 1), same / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)),
        max(map(len, words), default=0), sum(w[:1].isupper() for w in lines) / max(1, len(lines)),
    ]


@dataclass
class Trees:
    """Complete trees of one depth, flattened: inner nodes by breadth, then leaves."""

    base: float
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        if not len(self.feature):
            return np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range((self.leaf.shape[1]).bit_length() - 1):
            right = np.take_along_axis(x, self.feature[trees, node], 1) > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, node - self.feature.shape[1]].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2, ridge: float = 2.0) -> Trees:
    """Boost ``trees`` trees on the log loss. Without rows every score is 1; with one label only, that label's share."""
    none = np.zeros((0, 1))
    if not len(y) or y.min() == y.max():
        return Trees(float(y.mean()) if len(y) else 1.0, none, none, none)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    raw, inner = np.full(len(y), base), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = p - y, np.maximum(p * (1 - p), 1e-6), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = node - first
            best, where = np.full(wide, 1e-6), np.full(wide, -1)
            cut = np.zeros(wide, np.int64)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key = at * bins + binned[:, j]
                sums = [np.bincount(key, w, wide * bins).reshape(wide, bins).cumsum(1) for w in (g, h)]
                (gl, hl), (ga, ha) = sums, (s[:, -1:] for s in sums)
                gain = (gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge))[:, : len(edges[j])]
                k = gain.argmax(1)
                better = gain[np.arange(wide), k] > best
                best[better], where[better], cut[better] = gain[np.arange(wide), k][better], j, k[better]
            for i in np.flatnonzero(where >= 0):
                feature[t, first + i], threshold[t, first + i] = where[i], edges[where[i]][cut[i]]
            right = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        raw += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, sample: int, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most ``sample`` labelled rows outside the held-out fold, those whose ids hash lowest.

    Of texts under one id the one with the largest hash counts, and none of over ``LONGEST`` characters.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != held_out)).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample)
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t"))
    found = texts.where(F.coalesce(F.length("__t"), F.lit(0)) <= LONGEST).join(F.broadcast(chosen), "__id")  # at most ``sample`` rows are broadcast
    return found.groupBy("__id", "__y").agg(F.max_by("__t", F.xxhash64("__t")).alias("__t")).select("__t", "__y")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t) for t in batch.column("__t").to_pylist()], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows.T), batch.column("__y")], names=[*FEATURES, "y"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Fit on labelled rows whose crc32(doc_id) mod 4 is not 2; null and other labels don't count."""
    rows = labelled(docs, labels, "quality", 4, 2, sample, doc_id, text).mapInArrow(_features, ", ".join(f"{f} double" for f in FEATURES) + ", y int")
    got = np.array(sorted(tuple(r) for r in rows.collect()), np.float64).reshape(-1, len(FEATURES) + 1)  # at most ``sample`` rows
    return fit(got[:, :-1], got[:, -1])


def with_score(rows: DataFrame, model: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """``rows`` with the score of each whole text; empty texts get the score of their statistics."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return rows.withColumn(out, score(F.col(f"`{text}`")))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Repeated rows score alike; a null id is never held out.

    Null text counts as empty. Other columns, whatever their names, are not read. An empty table gives none; without labels all scores are 1.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scored = with_score(rows, train(docs, labels, doc_id=doc_id, text=text))
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, whole and with their own columns."""
    free = free_name(docs, "score")
    return with_score(docs, train(docs, labels), out=free).where(F.col(free) >= KEEP_AT).drop(free)
