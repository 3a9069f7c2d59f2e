"""Packing documents into token windows by non-negative least squares over length combinations.

A document of n tokens gives ``n // window`` full windows and one remainder. The remainders of a block of documents form a
histogram of lengths. All combinations of one to three lengths that fill a window are enumerated; how often each is to be
used comes from a non-negative least-squares fit of their summed lengths to the histogram; the fit is rounded down, so
that no length is used more often than it occurs; remainders left over are laid end to end, longest first, and cut at
window borders. A block therefore ends with at most one window that is not full. Blocks depend on nothing outside
themselves: no shuffle, and a lost task repeats alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy
from .tokens import encoder

#: Documents and tokens after which a block is closed; they bound a task's memory.
BLOCK_DOCS, BLOCK_TOKENS = 20_000, 6_000_000
#: The shortest of three lengths is at most this part of the window; it keeps the enumeration near 40,000 combinations.
SHALLOW = 10
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three of the given lengths, ascending and with 0 for none, that add up to the window; of three, one is short."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    a = lengths[lengths * 2 <= window]
    pairs = a[have[window - a]]
    found = [np.stack([np.zeros_like(pairs), pairs, window - pairs], 1)]
    for x in lengths[lengths * SHALLOW <= window]:
        y = lengths[(lengths >= x) & (lengths * 2 <= window - x)]
        y = y[have[window - x - y]]
        found.append(np.stack([np.full_like(y, x), y, window - x - y], 1))
    return np.concatenate(found)


def nnls(combos: np.ndarray, histogram: np.ndarray, steps: int = 40) -> np.ndarray:
    """x >= 0 that brings the lengths used by ``combos`` close to the histogram: accelerated projected gradient."""
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)

    def used(x):
        return np.bincount(combos.ravel(), np.repeat(x, 3), size)

    v = np.ones(len(combos))
    for _ in range(6):  # largest eigenvalue of A'A
        u = used(v)
        u[0] = 0
        v = u[combos].sum(1)
        v /= (norm := np.sqrt(v @ v))
    rate, x = 1 / (1.2 * norm), np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(steps):
        r = used(y) - histogram
        r[0] = 0
        new = np.maximum(0, y - rate * r[combos].sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def round_down(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts. The fit is rounded to the nearest and, where a length would be overdrawn, cut back greedily."""
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(combos), np.int64)

    def take(k, most):
        parts = combos[k].tolist()
        n = min(most, *(left[p] // parts.count(p) for p in parts if p))
        if n > 0:
            counts[k] += n
            for p in parts:
                left[p] -= n if p else 0

    wanted = np.flatnonzero(x >= 0.5)
    for k in wanted[np.argsort(-x[wanted], kind="stable")]:
        take(k, int(np.rint(x[k])))
    rest = np.flatnonzero(((left[combos] > 0) | (combos == 0)).all(1))
    for k in rest[np.argsort(-x[rest], kind="stable")]:  # exact fits that rounding has left
        take(k, len(histogram) << 40)
    return counts


def pack_block(totals: np.ndarray, window: int = 1024) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of every piece; documents and sequences are numbered from 0."""
    totals = np.asarray(totals, np.int64)
    full, rest = totals // window, totals % window
    docs = np.repeat(np.arange(len(totals)), full)
    first = np.cumsum(full) - full
    starts = (np.arange(len(docs)) - np.repeat(first, full)) * window
    parts = [(docs, starts, np.full(len(docs), window), np.arange(len(docs)), np.zeros(len(docs), np.int64))]
    sequence = len(docs)
    order = np.argsort(rest, kind="stable")
    order = order[rest[order] > 0]
    histogram = np.bincount(rest[order], minlength=window + 1)[: window + 1]
    combos = combinations(np.flatnonzero(histogram), window)
    counts = round_down(combos, nnls(combos, histogram), histogram)
    taken = (np.cumsum(histogram) - histogram).astype(np.int64)  # where the unused documents of a length begin in order

    def put(who, start, length, seq, off):
        parts.append(tuple(np.asarray(x, np.int64) for x in (who, start, length, seq, off)))

    for k in np.flatnonzero(counts):
        n, offset = counts[k], 0
        for length in combos[k][combos[k] > 0]:
            who = order[taken[length] : taken[length] + n]
            taken[length] += n
            put(who, full[who] * window, np.full(n, length), sequence + np.arange(n), np.full(n, offset))
            offset += length
        sequence += n
    ends = np.cumsum(histogram)
    loose = [order[taken[n] : ends[n]] for n in np.flatnonzero(histogram)[::-1]]
    who = np.concatenate(loose) if loose else np.zeros(0, np.int64)
    length = rest[who]
    at = np.cumsum(length) - length
    fits = np.minimum(length, window - at % window)
    put(who, full[who] * window, fits, sequence + at // window, at % window)
    cut = length > fits
    put(who[cut], full[who[cut]] * window + fits[cut], length[cut] - fits[cut], sequence + at[cut] // window + 1, np.zeros(cut.sum()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def pack(docs: DataFrame, vocabulary: str, *, end_id: int = 0, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents, each with ``end_id`` behind it.

    ``ids`` holds a piece's tokens as little-endian unsigned 32-bit integers. Defined results: a null or empty text is the
    end id alone; a null id is kept; repeated rows are packed each for itself; an empty table gives no piece; a text of any
    length is cut into as many windows as it fills; other columns are not read, whatever their names. ``sequence_id`` is unique over the table and follows from the row's partition, block and window.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, base = encoder(vocabulary), TaskContext.get().partitionId() << 36
        ids, tokens, n = [], [], 0

        def close():
            nonlocal base
            totals = np.array([len(t) // 2 for t in tokens], np.int64)
            doc, start, length, sequence, offset = pack_block(totals, window)
            for a in range(0, len(doc), 8192):
                b = slice(a, a + 8192)
                data = [np.frombuffer(tokens[d], "<u2", m, 2 * s).astype("<u4").tobytes() for d, s, m in zip(doc[b], start[b], length[b], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in doc[b]], pa.int64()), pa.array(start[b]), pa.array(length[b]), pa.array(data, pa.binary()), pa.array(totals[doc[b]]), pa.array(base + sequence[b]), pa.array(offset[b])],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            base += int(sequence.max()) + 1

        last = int(end_id).to_bytes(2, "little")
        for batch in batches:
            for k in range(batch.num_rows):
                i, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ids.append(i)
                tokens.append(encode.packed(text or "") + last)
                n += len(tokens[-1]) // 2
                if len(ids) >= BLOCK_DOCS or n >= BLOCK_TOKENS:
                    yield from close()
                    ids, tokens, n = [], [], 0
        if ids:
            yield from close()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
