"""Toxicity by a small bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a hashed word vector beside the mean of its hashed character-trigram vectors; one of more than ``PIECE`` characters enters as
overlapping pieces, each in a place of its own. Both directions run over windows of
``WINDOW`` words that overlap by ``WINDOW - STRIDE``; attention pools the states of a window and a logistic unit scores it. All windows of
a text are scored, and the text has the score of its worst window. Training sees document labels only: of each document the window that scores
highest stands for it.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewright.llm.quality_model import labelled
from slicewright.llm.textcols import crc_mod

#: Labelled rows that the network is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 6_000
WINDOW, STRIDE = 40, 34
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN = 65536, 16384, 8, 12, 8
#: Characters of a word, beyond which it is read as pieces, and from one piece's start to the next one's: what is not longer than ``PIECE - STEP`` is whole in some piece.
PIECE, STEP = 40, 20
#: Words whose projected inputs a worker keeps, after which it starts anew.
CACHE_WORDS = 150_000
TOXIC_AT = 0.5
#: Where the line runs in the gap between the lowest toxic and the highest other text that was learnt from, from the toxic side. It was chosen on rows of the
#: training fold that were not learnt from: every fifth one, see the README.
MARGIN = 0.12
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str | None) -> list[str]:
    """The words of a text, long ones as consecutive overlapping pieces."""
    words = (text or "").split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[at : at + PIECE] for w in words for at in range(0, max(1, len(w) - PIECE + STEP), STEP)]


def word_keys(word: str) -> tuple[int, list[int]]:
    """The row of the word's vector, and those of its character trigrams with edges."""
    plain = word.strip(_EDGE).lower() or word
    marked = f"<{plain}>"
    return zlib.crc32(plain.encode()) % WORD_ROWS, [zlib.crc32(marked[i : i + 3].encode()) % CHAR_ROWS for i in range(max(1, len(marked) - 2))]


class Keys:
    """The vectors' rows for a list of words, in flat arrays."""

    def __init__(self, words: Iterable[str]):
        word, chars, counts = array("i"), array("i"), array("i")
        for w in words:
            row, trigrams = word_keys(w)
            word.append(row)
            chars.extend(trigrams)
            counts.append(len(trigrams))
        self._set(*(np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (word, chars, counts)))

    def _set(self, word: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> None:
        self.word, self.chars, self.counts = word, chars, counts
        self.starts = np.cumsum(counts, dtype=np.int64) - counts

    def take(self, rows: np.ndarray) -> Keys:
        out, n = Keys(()), self.counts[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(n, dtype=np.int64) - n), n) + np.arange(n.sum())
        out._set(self.word[rows], self.chars[at], n)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The weights, and the passes over blocks of windows (time first)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        dim = WORD_DIM + CHAR_DIM
        self.w = {"word": f(WORD_ROWS, WORD_DIM, scale=0.1), "char": f(CHAR_ROWS, CHAR_DIM, scale=0.3)}
        for d in "fb":
            self.w |= {f"x{d}": f(dim, 3 * HIDDEN, scale=dim**-0.5), f"h{d}": f(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.w |= {"attend": f(2 * HIDDEN, scale=0.3), "out": f(2 * HIDDEN, scale=0.5), "bias": np.zeros(1, np.float32)}
        self.shift = 0.0

    def embed(self, keys: Keys) -> np.ndarray:
        """The inputs of words, some at a time, so that the gathered trigram vectors stay few."""
        out = np.empty((len(keys.word), WORD_DIM + CHAR_DIM), np.float32)
        for at in range(0, len(out), 20_000):
            part = keys.take(np.arange(at, min(len(out), at + 20_000)))
            out[at : at + 20_000, :WORD_DIM] = self.w["word"][part.word]
            out[at : at + 20_000, WORD_DIM:] = np.add.reduceat(self.w["char"][part.chars], part.starts, axis=0) / part.counts[:, None] ** 0.5
        return out

    def run(self, gates: dict[str, np.ndarray], rows: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ``rows`` (time x windows) index the projected words in ``gates``, ``mask`` is 1 where a word is."""
        steps, n = rows.shape
        states, tape = np.zeros((steps, n, 2 * HIDDEN), np.float32), []
        for d, at in (("f", 0), ("b", HIDDEN)):
            h, wh = np.zeros((n, HIDDEN), np.float32), self.w[f"h{d}"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, before = gates[d][rows[t]], h
                zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ wh[:, : 2 * HIDDEN])
                z, rgate = zr[:, :HIDDEN], zr[:, HIDDEN:]
                hn = np.tanh(x[:, 2 * HIDDEN :] + (rgate * h) @ wh[:, 2 * HIDDEN :])
                m = mask[t][:, None]
                h = h + m * z * (hn - h)
                states[t, :, at : at + HIDDEN] = h
                if keep:
                    tape.append((d, t, before, z, rgate, hn))
        a = states @ self.w["attend"] - 1e4 * (1 - mask)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnd->nd", a, states)
        logits = pooled @ self.w["out"] + self.w["bias"][0]
        return (logits, (states, a, pooled, tape)) if keep else logits

    def gates(self, embedded: np.ndarray) -> dict[str, np.ndarray]:
        return {d: embedded @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"}

    def gradients(self, embedded: np.ndarray, rows: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the weighted log loss, by back-propagation through time; second, by embedded word."""
        logits, (states, a, pooled, tape) = self.run(self.gates(embedded), rows, mask, keep=True)
        w, g = self.w, {}
        d_logit = ((_sigmoid(logits) - y) * weight / weight.sum()).astype(np.float32)
        g["bias"], g["out"] = d_logit.sum(keepdims=True), pooled.T @ d_logit
        d_pool = d_logit[:, None] * w["out"]
        along = np.einsum("tnd,nd->tn", states, d_pool)
        d_a = a * (along - (a * along).sum(0))
        g["attend"] = np.einsum("tn,tnd->d", d_a, states)
        d_states = a[:, :, None] * d_pool + d_a[:, :, None] * w["attend"]
        d_gate = {d: np.zeros((len(embedded), 3 * HIDDEN), np.float32) for d in "fb"}
        for d in "fb":
            g[f"h{d}"] = np.zeros_like(w[f"h{d}"])
        carry = {d: np.zeros((rows.shape[1], HIDDEN), np.float32) for d in "fb"}
        for d, t, before, z, r, hn in reversed(tape):
            at, wh, m = (0 if d == "f" else HIDDEN), w[f"h{d}"], mask[t][:, None]
            dh = carry[d] + d_states[t, :, at : at + HIDDEN]
            dz = dh * m * (hn - before) * z * (1 - z)
            dn = dh * m * z * (1 - hn**2)
            d_rh = dn @ wh[:, 2 * HIDDEN :].T
            dr = d_rh * before * r * (1 - r)
            d_zr = np.concatenate([dz, dr], 1)
            g[f"h{d}"][:, : 2 * HIDDEN] += before.T @ d_zr
            g[f"h{d}"][:, 2 * HIDDEN :] += (r * before).T @ dn
            np.add.at(d_gate[d], rows[t], np.concatenate([d_zr, dn], 1))
            carry[d] = dh * (1 - m * z) + d_rh * r + d_zr @ wh[:, : 2 * HIDDEN].T
        d_embedded = np.zeros_like(embedded)
        for d in "fb":
            g[f"x{d}"], g[f"c{d}"] = embedded.T @ d_gate[d], d_gate[d].sum(0)
            d_embedded += d_gate[d] @ w[f"x{d}"].T
        return g, d_embedded


class Reader:
    """Texts to windows of word numbers, with the projected inputs of the words seen so far."""

    def __init__(self, net: Network):
        self.net, self.index, self.tables, self.used = net, {}, {}, 1
        self._reset()

    def _reset(self) -> None:
        self.index.clear()
        self.used = 1  # row 0 is padding
        self.tables = {d: np.zeros((4096, 3 * HIDDEN), np.float32) for d in "fb"}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text: its worst window's."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        split = [words_of(t) for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.index))
        if new:
            need = self.used + len(new)
            made = self.net.gates(self.net.embed(Keys(new)))
            for d in "fb":
                if need > len(self.tables[d]):
                    self.tables[d] = np.concatenate([self.tables[d], np.zeros((need, 3 * HIDDEN), np.float32)])
                self.tables[d][self.used : need] = made[d]
            self.index.update(zip(new, range(self.used, need), strict=True))
            self.used = need
        rows, mask, owner = windows([np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)) for words in split])
        worst = np.full(len(texts), -np.inf)
        for at in range(0, rows.shape[1], 8192):
            np.maximum.at(worst, owner[at : at + 8192], self.net.run(self.tables, rows[:, at : at + 8192], mask[:, at : at + 8192]))
        return 1 / (1 + np.exp(-(worst + self.net.shift)))


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, mask, owner) of all overlapping windows, time first; an empty text has one window of padding."""
    counts = np.array([max(1, 1 + -(-(len(t) - WINDOW) // STRIDE)) if len(t) else 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([*texts, np.zeros(1, np.int64)]) if texts else np.zeros(1, np.int64)
    base = np.cumsum(lengths) - lengths
    local = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    place = local[None, :] + np.arange(WINDOW)[:, None]
    mask = place < lengths[owner][None, :]
    return np.where(mask, flat[np.where(mask, base[owner][None, :] + place, 0)], 0), mask.astype(np.float32), owner


def fit(rows: list[tuple[str | None, int]], rounds: int = 12, seed: int = 7) -> Network:
    """Train on (text, label) rows. Without rows of both labels every score is near 0, or near 1 if all are toxic."""
    net = Network(seed)
    y = np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        net.shift = 20.0 if len(y) and y[0] else -20.0
        net.w["out"][:] = 0
        return net
    vocabulary: dict[str, int] = {}
    numbered = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t, _ in rows]
    keys = Keys(vocabulary or [""])
    del vocabulary
    all_rows, all_mask, owner = windows(numbered)
    first = np.searchsorted(owner, np.arange(len(rows)))
    r, moments, step = np.random.default_rng(seed), {}, 0
    for round_ in range(rounds):
        gates = net.gates(net.embed(keys))
        logits = np.concatenate([net.run(gates, all_rows[:, i : i + 8192], all_mask[:, i : i + 8192]) for i in range(0, len(owner), 8192)])
        order = np.lexsort((-logits, owner))
        top = order[first]
        last = np.append(first[1:], len(owner))
        other = (first + r.random(len(rows)) * (last - first)).astype(np.int64)
        clean = np.flatnonzero(y == 0)
        if round_ < 2:  # nothing is known yet: any window of a toxic text may be the one
            top = np.where(y == 1, other, top)
        picked, label = np.concatenate([top, other[clean]]), np.concatenate([y, y[clean]])
        weight = np.where(label == 1, len(label) / max(1, (label == 1).sum()), 1.0).astype(np.float32)
        for batch in np.array_split(r.permutation(len(picked)), max(1, len(picked) // 256)):
            rows_b, mask_b = all_rows[:, picked[batch]], all_mask[:, picked[batch]]
            used, local = np.unique(rows_b, return_inverse=True)
            some = keys.take(used)
            g, d_e = net.gradients(net.embed(some), local.reshape(rows_b.shape), mask_b, label[batch], weight[batch])
            step += 1
            g["word"], g["char"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["char"])
            np.add.at(g["word"], some.word, d_e[:, :WORD_DIM])
            np.add.at(g["char"], some.chars, np.repeat(d_e[:, WORD_DIM:] / some.counts[:, None] ** 0.5, some.counts, axis=0))
            for name, grad in g.items():
                m, v = moments.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                net.w[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    gates = net.gates(net.embed(keys))
    logits = np.concatenate([net.run(gates, all_rows[:, i : i + 8192], all_mask[:, i : i + 8192]) for i in range(0, len(owner), 8192)])
    worst = np.maximum.reduceat(logits, first)
    order = np.argsort(-worst, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = worst[order[k + 1]] if k + 1 < len(order) else worst[order[k]] - 1
    net.shift = -float(worst[order[k]] - MARGIN * (worst[order[k]] - below))
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Network:
    """Fit on labelled rows whose crc32(doc_id) mod 5 is not 0: up to a quarter of the sample toxic ones, up to half of it others."""
    got = []
    for label, most in ((1, sample // 4), (0, sample // 2)):
        got += [tuple(r) for r in labelled(docs, labels.where(F.col("toxic") == label), "toxic", 5, 0, most, doc_id, text).collect()]  # at most ``sample`` rows
    return fit(sorted(got, key=lambda r: (r[1], r[0] or "")))


def _scorer(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(reader.score(piece.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. Null text counts as empty, and empty texts have a window of padding; repeated rows score alike; a null id is never held out.

    Other columns, whatever their names, are not read. An empty table gives none; without labels all scores are near 0.
    """
    net = train(docs, labels, doc_id=doc_id, text=text)
    held = F.coalesce(crc_mod(F.col(f"`{doc_id}`"), 5) == 0, F.lit(False))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held.alias("held_out"), F.col(f"`{text}`").alias("text")).mapInArrow(_scorer(net), f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= TOXIC_AT).cast("int"))
