"""Quality rules: exact text statistics with fixed limits, and a calibrated model's verdict for what passes them.

The model is a logistic regression over hashed word and character n-grams,
trained on labelled rows.  Its log odds are calibrated on the part of those
rows that training left out; verdicts compare the probability with a fixed
threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashed import Rows, Spec, batches_of, rows_of, sample, sigmoid, totals, units
from .textbatch import Slice, Words, code_points, same_bytes, slices, spans_hash, windows, words

SPEC = Spec(chars=(2, 3), words=(1, 2), bits=17)
# What counts as a symbol, and the limits of the base rules.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


class Exact:
    """Groups of equal byte spans: hashes find them and bytes confirm them.

    Spans whose hashes agree though their bytes differ are numbered by their
    bytes instead, all of them.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        self.order = np.argsort(h, kind="stable")
        k = h[self.order]
        same = np.concatenate([[False], k[1:] == k[:-1]])
        a, b = self.order[:-1][same[1:]], self.order[1:][same[1:]]
        size = end - start
        if (size[a] == size[b]).all() and same_bytes(data, start[a], start[b], size[b]):
            self.number = np.zeros(len(h), np.int64)
            self.number[self.order] = np.cumsum(~same)
        else:
            seen: dict[bytes, int] = {}
            self.number = np.array([seen.setdefault(data[i:j].tobytes(), len(seen)) for i, j in zip(start, end, strict=True)], np.int64)


def _equal_before(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) entries of one row and number, next to each other in order."""
    order = np.lexsort((number, row))
    same = np.flatnonzero((number[order][1:] == number[order][:-1]) & (row[order][1:] == row[order][:-1]))
    return order[same], order[same + 1]


def repeated_windows(data: np.ndarray, w: Words, size: int) -> np.ndarray:
    """First words of the windows of size words that occur twice or more in their row."""
    h, at = windows(w, size)
    row = w.row()
    a, b = _equal_before(row[at], h.view(np.int64))
    a, b = at[a], at[b]
    if not len(a):
        return a
    used = np.zeros(len(row) + 1, np.int64)
    for x in (a, b):
        np.add.at(used, x, 1)
        np.add.at(used, x + size, -1)
    used = np.flatnonzero(np.cumsum(used)[:-1] > 0)
    number = np.full(len(row), -1, np.int64)
    number[used] = Exact(data, w.start[used], w.end[used], w.hash[used]).number
    if any((number[a + j] != number[b + j]).any() for j in range(size)):
        # Windows whose hashes agree though their words differ: all are numbered by their words.
        number = Exact(data, w.start, w.end, w.hash).number
        seen: dict[tuple, int] = {}
        each = np.array([seen.setdefault(tuple(number[i : i + size].tolist()), len(seen)) for i in at], np.int64)
        a, b = _equal_before(row[at], each)
        a, b = at[a], at[b]
    return np.unique(np.concatenate([a, b]))


def statistics(part: Slice, w: Words | None = None) -> list[np.ndarray]:
    """For each row the columns of STATS; lines and windows are equal where their bytes are, not their hashes alone."""
    w = words(part) if w is None else w
    data, n, row = part.data, part.last - part.first, w.row()
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[part.offs])
    points = np.concatenate([[0], np.cumsum(code_points(data))])
    word_chars = np.bincount(row, points[w.end] - points[w.start], n).astype(np.int64)
    twice = repeated_windows(data, w, WINDOW)
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeat = np.bincount(row, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)
    # Lines end at a newline or with their row.
    newline = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([part.offs[:-1], newline + 1]))
    start = start[start < len(data)]
    end = np.minimum(np.append(start[1:], len(data)), len(data))
    end = np.where(data[end - 1] == 0x0A, end - 1, end) if len(start) else end
    owner = np.searchsorted(part.offs, start, "right") - 1
    has_word = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    start, end, owner = start[has_word], end[has_word], owner[has_word]
    _, later = _equal_before(owner, Exact(data, start, end, spans_hash(data, start, end)).number)
    dup = np.bincount(owner[later], minlength=n).astype(np.int64)
    return [np.diff(w.of), word_chars, count(_SYMBOL[data]), dup, repeat]


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float  # calibration: probability = sigmoid(slope * log odds + shift)
    shift: float


def train(rows: Rows, y: np.ndarray, bits: int, epochs: int = 10, rate: float = 0.5, l2: float = 1e-6, batch: int = 32, seed: int = 11) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(seed)
    w, b, past, past_b = np.zeros(1 << bits), 0.0, np.full(1 << bits, 1e-10), 1e-6
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for some in batches_of(len(y), batch, rng):
            x = rows.take(some)
            own = x.owner()
            error = sigmoid(np.bincount(own, w[x.bucket] * x.share, len(some)) + b) - y[some]
            used, where = np.unique(x.bucket, return_inverse=True)
            grad = np.bincount(where, x.share * error[own], len(used)) + l2 * w[used]
            past[used] += grad**2
            w[used] -= step * grad / np.sqrt(past[used])
            past_b += error.sum() ** 2
            b -= step * error.sum() / np.sqrt(past_b)
    return w, b


def calibrate(odds: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic fit to (log odds, label) by Newton's method, with smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * odds + b)
        g = np.array([((p - target) * odds).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * odds * odds).sum() + 1e-6, (v * odds).sum()], [(v * odds).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 5000, spec: Spec = SPEC) -> Model:
    """Learn from at most max_rows labelled rows' whole texts; a fifth of those is kept for calibration.

    Without rows of both labels every text has the share of label 1.
    """
    texts, y = sample(docs, labels.filter(F.col(label).isin(0, 1)), label, max_rows)
    y = np.array(y, float)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        return Model(np.zeros(1 << spec.bits), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1.0, 0.0)
    rows = rows_of(texts, spec)
    w, b = train(rows.take(np.flatnonzero(~held)), y[~held], spec.bits)
    x = rows.take(np.flatnonzero(held))
    odds = np.bincount(x.owner(), w[x.bucket] * x.share, int(held.sum())) + b
    return Model(w, b, *calibrate(odds, y[held]))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 5000, spec: Spec = SPEC) -> DataFrame:
    """docs with the base statistics, base_failed, probability (of label 1) and kept.

    A null or empty text has no words and fails the base rules.  A very long
    text is looked at whole, at some 100 bytes of memory for each of its own.
    Of one id's labels that differ the least counts.  All rows come back once
    each; columns of these names are replaced; an empty table gives an empty
    result.
    """
    model = fit(docs, labels, max_rows=max_rows, spec=spec)
    weights = model.weights.astype(np.float32)
    names = [f.split()[0] for f in STATS.split(", ")]
    docs = docs.drop(*names, "base_failed", "probability", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
            odds = [np.zeros(0)]
            for part in slices(batch.column("text")):
                u = units(part, spec)
                for column, values in zip(columns, statistics(part, u.words), strict=True):
                    column.append(values)
                sums, count = totals(u, weights)
                odds.append(sums[:, 0] / np.maximum(count, 1) + model.bias)
            p = sigmoid(model.slope * np.concatenate(odds) + model.shift)
            made = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(p)], names=[*batch.schema.names, *names, "probability"])

    added = [T.StructField(name, T.LongType()) for name in names] + [T.StructField("probability", T.DoubleType())]
    out = docs.mapInArrow(run, T.StructType(docs.schema.fields + added))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= threshold))
