"""Toxicity of whole texts: a recurrent network over all overlapping windows of words, trained from labels.

A word enters as a vector of word and character inputs: a learned vector of the word and the mean of learned vectors of its
character n-grams (prefixes and inner runs), both hashed and trained with the network, and beside them how often, in
labelled documents, the word and its n-grams go with the label (shrunk log odds). A window of 32 words goes through a
bidirectional gated network with attention pooling; windows overlap by half, and a document's score comes from its highest
window. The label of a document says that some window is toxic, not which: each training round takes the highest windows
under the network so far. Log odds and network are fitted on different parts of the sample, so that the network does not
trust what it has seen.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import recurrent
from .common import as_bytes, held_out, own_cache, slices, table, trim

#: Words of a window, words between two windows, states of the network, dimensions of learned word and n-gram vectors.
WINDOW, STRIDE, HIDDEN, LEARNED = 32, 16, 8, 6
EVIDENCE = 4
INPUTS = EVIDENCE + 2 * LEARNED
#: At most so many labelled documents of each label, and bytes of text in all, are learned from; drawn by a hash of the id.
SAMPLE, SAMPLE_BYTES = 3000, 64 << 20
THRESHOLD = 0.7
#: Hash buckets of log odds and of learned vectors; the row behind the last stands for "none" and stays zero.
_NONE, _FEW = 1 << 18, 1 << 16
#: Words that a worker remembers, bytes of a text that are split into words at once.
_CACHE, _PIECE = 160_000, 1 << 20


def _grams(word: bytes) -> list[int]:
    """Hash buckets of the word's prefixes of 3 to 6 bytes and of its inner runs of 5."""
    if len(word) < 3:
        return [_NONE]
    out = [zlib.crc32(word[:k], 0x5EED) % _NONE for k in range(3, min(6, len(word)) + 1)]
    return out + [zlib.crc32(word[k : k + 5]) % _NONE for k in range(1, len(word) - 4)]


def _word(text: bytes) -> int:
    return zlib.crc32(text, 0x0DD) % _NONE if text else _NONE


_EDGES = b".,;:!?\"'()|#*$%&<>"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _core(word: bytes) -> bytes:
    """A word without case and without marks at its edges."""
    return word.strip(_EDGES).decode("utf-8", "replace").lower().encode()


def _folded(buckets: np.ndarray) -> np.ndarray:
    return np.where(buckets == _NONE, _FEW, buckets % _FEW)


class Words:
    """Word and n-gram buckets of a list of words: those of word k are ``flat[at[k] : at[k] + n[k]]``."""

    def __init__(self, words: list[bytes]):
        cores = [_core(w) for w in words]
        grams = [_grams(c) for c in cores]
        self.word = np.array([_word(c) for c in cores], np.int64)
        self.size = np.array([min(len(c), 20) / 20 for c in cores], np.float32)
        self.n = np.array([len(g) for g in grams], np.int64)
        self.flat = np.fromiter(itertools.chain.from_iterable(grams), np.int32, self.n.sum())
        self.at = np.cumsum(self.n) - self.n

    def grams_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-gram buckets of some words, one word behind the other, where each begins, and their numbers."""
        n = self.n[rows]
        at = np.cumsum(n) - n
        return self.flat[np.arange(n.sum()) + np.repeat(self.at[rows] - at, n)], at, n


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    word_vectors: np.ndarray
    gram_vectors: np.ndarray
    net: recurrent.Params
    scale: tuple[float, float]

    def inputs(self, words: Words, rows: np.ndarray | None = None) -> np.ndarray:
        """The network's inputs for words, one row each."""
        rows = np.arange(len(words.n)) if rows is None else rows
        out = np.empty((len(rows), INPUTS), np.float32)
        if len(rows):
            flat, at, n = words.grams_of(rows)
            odds = self.grams[flat]
            out[:, 0], out[:, 1], out[:, 2], out[:, 3] = self.words[words.word[rows]], np.maximum.reduceat(odds, at), np.add.reduceat(odds, at) / n, words.size[rows]
            out[:, EVIDENCE : EVIDENCE + LEARNED] = self.word_vectors[_folded(words.word[rows])]
            out[:, EVIDENCE + LEARNED :] = np.add.reduceat(self.gram_vectors[_folded(flat)], at) / n[:, None]
        return out


class _Gates(dict):
    """Word -> row of two growing tables: what the input parts of the network's gates make of it. Row 0 is padding."""

    def __init__(self, model: Model):
        self.model = model
        self.net = {k: v.astype(np.float32) for k, v in model.net.items()}
        self.tables = [np.zeros((4096, 3 * HIDDEN), np.float32) for _ in "fb"]
        self.new: list[bytes] = []
        self.done = 1

    def __missing__(self, word: bytes) -> int:
        self[word] = k = self.done + len(self.new)
        self.new.append(word)
        return k

    def sync(self) -> None:
        """Compute the rows of words that have been met since."""
        if not self.new:
            return
        x = self.model.inputs(Words(self.new))
        a, b = self.done, self.done + len(x)
        for k, side in enumerate("fb"):
            if b > len(self.tables[k]):
                self.tables[k] = np.concatenate([self.tables[k][:a], np.zeros((b + b // 4 - a, 3 * HIDDEN), np.float32)])
            self.tables[k][a:b] = x @ self.net[f"W{side}"] + self.net[f"c{side}"]
        self.new, self.done = [], b

    def trim(self) -> None:
        if len(self) > _CACHE:
            self.clear()
            self.done = 1


def pieces(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """(words, windows) whose windows together are those of the whole text; a short text is one piece."""
    carry, at = [], 0
    while len(text) - at > 2 * _PIECE:
        end = _SPACE.search(text, at + _PIECE)
        if end is None:
            break
        words = carry + text[at : end.start()].split()
        at = end.start()
        n = max(0, (len(words) - WINDOW) // STRIDE + 1)
        if n:
            yield words, n
        carry = words[n * STRIDE :]
    words = carry + (text[at:] if at else text).split()
    yield words, len(windows(len(words)))


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows that cover n words; one window for an empty text."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _frames(ids: list[np.ndarray], counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW) rows of the words' table, padded with 0, and the piece of each window."""
    starts = [windows(len(x)) if counts is None else np.arange(0, counts[k] * STRIDE, STRIDE) for k, x in enumerate(ids)]
    need = [max(int(s[-1]) + WINDOW, len(x)) for s, x in zip(starts, ids, strict=True)]
    flat = np.zeros(sum(need), np.int32)
    base = np.cumsum([0, *need])
    for x, b in zip(ids, base, strict=False):
        flat[b : b + len(x)] = x
    at = np.concatenate([s + b for s, b in zip(starts, base, strict=False)])
    return flat[at[:, None] + np.arange(WINDOW)], np.repeat(np.arange(len(ids)), [len(s) for s in starts])


def document_logits(gates: _Gates, texts: list[bytes]) -> np.ndarray:
    """The highest window of each text."""
    out = np.full(len(texts), -np.inf)
    for k, group in enumerate([texts] if sum(map(len, texts)) <= 2 * _PIECE else [[t] for t in texts]):
        split = ((k + i, words, n) for i, t in enumerate(group) for words, n in pieces(t))
        for batch in [list(split)] if len(group) > 1 or len(group[0]) <= 2 * _PIECE else ([x] for x in split):
            doc, words, counts = zip(*batch, strict=True)
            ids = [np.fromiter(map(gates.__getitem__, w), np.int32, len(w)) for w in words]
            frames, piece = _frames(ids, list(counts))
            gates.sync()
            best = np.full(len(batch), -np.inf)
            for a in range(0, len(frames), 2048):
                idx = np.ascontiguousarray(frames[a : a + 2048].T)
                logits = recurrent.forward(gates.net, gates.tables[0][idx], gates.tables[1][idx], (idx > 0).astype(np.float32))
                np.maximum.at(best, piece[a : a + 2048], logits)
            np.maximum.at(out, np.array(doc), best)
            gates.trim()
    return out


def _log_odds(texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log odds of words and n-grams by document: the estimate less its standard error, and 0 if that turns it."""
    counts = np.zeros((2, 2, _NONE + 1))
    for text, label in zip(texts, y.astype(int), strict=True):
        distinct = set(map(_core, set(text.split())))
        counts[0, label, list({_word(w) for w in distinct})] += 1
        counts[1, label, list({g for w in distinct for g in _grams(w)})] += 1
    n = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    odds = np.log((counts[:, 1] + 0.5) / (n[1] + 1)) - np.log((counts[:, 0] + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (counts[:, 1] + 0.5) + 1 / (counts[:, 0] + 0.5))
    shrunk = (np.sign(odds) * np.maximum(0, np.abs(odds) - error)).astype(np.float32)
    shrunk[:, _NONE] = 0
    return shrunk[0], shrunk[1]


class _Learned:
    """Steps on the learned vectors: a rate of its own for each number, from its past gradients; only rows met move."""

    def __init__(self, model: Model, rate: float = 0.05, decay: float = 1e-3):
        self.rate, self.decay = rate, decay
        self.sides = [(model.word_vectors, np.full_like(model.word_vectors, 0.1)), (model.gram_vectors, np.full_like(model.gram_vectors, 0.1))]

    def step(self, side: int, buckets: np.ndarray, gradients: np.ndarray) -> None:
        vectors, past = self.sides[side]
        rows, at = np.unique(buckets, return_inverse=True)
        g = np.stack([np.bincount(at, gradients[:, k], len(rows)) for k in range(LEARNED)], 1) + self.decay * vectors[rows]
        past[rows] += g * g
        vectors[rows] -= self.rate * g / np.sqrt(past[rows])
        vectors[_FEW] = 0


def train(texts: list[bytes], labels: np.ndarray, *, rounds: int = 5, epochs: int = 3, seed: int = 1) -> Model:
    """Fit log odds on two thirds of the rows, network and learned vectors on the rest; then scale scores."""
    y = np.asarray(labels, float)
    rng = np.random.default_rng(seed)
    net = recurrent.initial(INPUTS, HIDDEN, seed)
    empty = lambda *shape: np.zeros(shape, np.float32)
    model = Model(empty(_NONE + 1), empty(_NONE + 1), empty(_FEW + 1, LEARNED), empty(_FEW + 1, LEARNED), net, (1.0, 0.0))
    if not len(y) or y.min() == y.max():
        net["o"][:] = 0
        model.scale = (1.0, -3.0 if not len(y) or not y.max() else 3.0)
        return model
    order = np.argsort(rng.random(len(y)))
    split = np.zeros(len(y), bool)
    for k in (0, 1):  # the same share of each label in both parts
        mine = order[y[order] == k]
        split[mine[: max(1, (2 * len(mine)) // 3)]] = True
    model.words, model.grams = _log_odds([t for t, s in zip(texts, split, strict=True) if s], y[split])
    rest = np.flatnonzero(~split)
    if len(set(y[rest])) < 2:
        rest = np.arange(len(y))
    known: dict[bytes, int] = {}
    empties = [b""] * max(1, len(rest) // 40)  # clean texts without a word, so that these score low
    ids = [np.array([known.setdefault(w, len(known) + 1) for w in t.split()], np.int32) for t in [texts[k] for k in rest] + empties]
    frames, doc = _frames(ids)
    words = Words([b"", *known])  # row 0 is padding
    del known, ids
    target = np.r_[y[rest], np.zeros(len(empties))]
    # Before the first round a window's log odds are the best guess at which one is toxic.
    guess = model.inputs(words)[:, :2].max(1)[frames].max(1) + 1e-3 * rng.random(len(frames))
    adam, learned = recurrent.Adam(net), _Learned(model)
    balance = np.where(target == 1, len(target) / (2 * max(1, target.sum())), len(target) / (2 * max(1, (1 - target).sum())))
    for _ in range(rounds):
        ranked = np.lexsort((-guess, doc))
        first = np.r_[True, doc[ranked][1:] != doc[ranked][:-1]]
        top = ranked[first]
        second = ranked[np.flatnonzero(first)[:-1] + 1]  # the next one of clean documents
        second = second[(target[doc[second]] == 0)]
        any_clean = np.flatnonzero(target[doc] == 0)
        chosen = np.concatenate([top, second, rng.choice(any_clean, min(len(top), len(any_clean)), replace=False)])
        for _ in range(epochs):
            rng.shuffle(chosen)
            for a in range(0, len(chosen), 256):
                pick = chosen[a : a + 256]
                rows, idx = np.unique(frames[pick].T, return_inverse=True)
                x = model.inputs(words, rows)[idx].astype(float)
                _, g = recurrent.gradients(net, x, (frames[pick].T > 0).astype(float), target[doc[pick]], balance[doc[pick]])
                dx = g.pop("x")[..., EVIDENCE:].reshape(-1, 2 * LEARNED)
                dx = np.stack([np.bincount(idx.ravel(), dx[:, k], len(rows)) for k in range(2 * LEARNED)], 1)
                flat, _, n = words.grams_of(rows)
                learned.step(0, _folded(words.word[rows]), dx[:, :LEARNED])
                learned.step(1, _folded(flat), np.repeat(dx[:, LEARNED:] / n[:, None], n, 0))
                adam.step(net, g)
        inputs, low = model.inputs(words), {k: v.astype(np.float32) for k, v in net.items()}
        guess = np.empty(len(frames))
        for a in range(0, len(frames), 2048):
            idx = frames[a : a + 2048].T
            x = inputs[idx]
            guess[a : a + 2048] = recurrent.forward(low, x @ low["Wf"] + low["cf"], x @ low["Wb"] + low["cb"], (idx > 0).astype(np.float32))
    best = np.full(len(target), -np.inf)
    np.maximum.at(best, doc, guess)
    model.scale = _platt(best, target)
    return model


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale (a, b) of probabilities 1 / (1 + exp(-(a x + b))), by Newton steps; a stays positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = max(0.05, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``sample`` documents of each label whose id may be learned from, and at most ``SAMPLE_BYTES`` of text.

    Ids are drawn first; they are few enough to broadcast whatever the size of the tables. Ids with contradicting labels
    are left out; of rows that share an id all are learned from; null texts count as empty ones.
    """
    own = labels.where(~held_out(id_col)).groupBy(id_col).agg(F.min("toxic").alias("y"), F.max("toxic").alias("y2")).where("y = y2 AND y IN (0, 1)")
    parts = [own.where(F.col("y") == k).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("__id"), "y") for k in (0, 1)]
    narrow = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("t"))
    rows = narrow.join(F.broadcast(parts[0].union(parts[1])), F.col("__doc") == F.col("__id")).select("__id", "y", "t")
    size = F.sum(F.coalesce(F.octet_length("t"), F.lit(0))).over(Window.orderBy(F.xxhash64("__id"), "__id", "t").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES).select("__id", "y", "t").toArrow()
    texts = as_bytes(rows.column("t").combine_chunks())
    ids = rows.column("__id").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return [texts[k] for k in order], rows.column("y").to_numpy()[order].astype(float)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    return train(*training_rows(docs, labels, id_col, text_col, sample))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text.

    Defined results: a null or empty text is one window without words and gets the same low score; without labels of both
    kinds all scores are equal; repeated rows get equal scores; very long texts are read piece by piece, in all their
    windows; an empty table gives an empty table; other columns are carried along, whatever their names.
    """
    a, b = model.scale
    name = zlib.crc32(b"".join(v.tobytes() for v in (*model.net.values(), model.words, model.grams, model.word_vectors, model.gram_vectors)))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own_cache(_forget)
        if _STATE.get("name") != name:
            _STATE.update(name=name, gates=_Gates(model))
        try:
            for column in batches:
                x = np.concatenate([np.zeros(0), *(document_logits(_STATE["gates"], texts) for texts in slices(column))])
                yield pa.array(1 / (1 + np.exp(-np.clip(a * x + b, -40, 40))))
        finally:
            trim()

    return docs.withColumn(score_col, run(F.col(text_col)))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score at or above the threshold; columns as they were.

    Defined results: null and empty texts stay, as their score is low; repeated rows stay or go together; without labels of
    both kinds all stay, or all go if every label is toxic; an empty table stays empty; columns of any name are carried
    along, but for ``__toxicity``, which is reserved.
    """
    scored = score(docs, model, text_col, "__toxicity")
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: The model and words of this worker process.
_STATE: dict = {}


def _forget() -> None:
    _STATE.clear()
