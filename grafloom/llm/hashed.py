"""Hashed word and character n-gram features of texts, and sums of learned weights over them.

Character n-grams lie within a word between two end marks, so that they need
be found once per distinct word of a slice, not once per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import _U, POWERS, Slice, Words, code_points, mix, prefix, slices, windows, words


class Spec(NamedTuple):
    """Character n-gram sizes (in code points), word n-gram sizes, and the number of hash bits."""

    chars: tuple[int, ...]
    words: tuple[int, ...] = ()
    bits: int = 18

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)


class Units(NamedTuple):
    """The words of a slice; distinct[i] says which distinct word each is; bucket and owner: features of the distinct ones."""

    words: Words
    distinct: np.ndarray
    n_distinct: int
    bucket: np.ndarray
    owner: np.ndarray
    pairs: list[tuple[np.ndarray, np.ndarray]]  # buckets of longer word n-grams, and the row of each


def units(part: Slice, spec: Spec) -> Units:
    w = words(part)
    distinct, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    n = len(distinct)
    buckets, owners = [], []
    if 1 in spec.words:
        buckets.append(spec.bucket(mix(distinct + _U(1))))
        owners.append(np.arange(n))
    if spec.chars and n:
        start, size = w.start[first], w.end[first] - w.start[first]
        own = np.repeat(np.arange(n), size)
        run = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        at = np.cumsum(size + 2) - size - 2
        marked = np.full(len(own) + 2 * n, 3, np.uint8)
        marked[at] = 2
        marked[at[own] + 1 + run] = part.data[start[own] + run]
        points = np.add.reduceat(code_points(marked).astype(np.int64), at)
        cp = np.frombuffer(marked.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        word, pre = np.repeat(np.arange(n), points), prefix(cp)
        for k in spec.chars:
            if len(cp) >= k:
                i = np.flatnonzero(word[: len(cp) - k + 1] == word[k - 1 :])
                h = (pre[i + k] - pre[i]) * POWERS.to(len(pre))[1][i]
                buckets.append(spec.bucket(mix(h + _U(k))))
                owners.append(word[i])
    row = w.row()
    pairs = []
    for k in spec.words:
        if k > 1:
            h, at = windows(w, k)
            pairs.append((spec.bucket(mix(h + _U(k))), row[at]))
    none = np.zeros(0, np.int64)
    return Units(w, which, n, np.concatenate(buckets or [none]), np.concatenate(owners or [none]), pairs)


def by_row(w: Words, values: np.ndarray) -> np.ndarray:
    """Sums over each row's words."""
    c = np.zeros(len(values) + 1)
    np.cumsum(values, out=c[1:])
    return c[w.of[1:]] - c[w.of[:-1]]


def totals(u: Units, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sum of weights over all its features (a column for each of weights'), and how many there are."""
    n = len(u.words.of) - 1
    weights = weights if weights.ndim == 2 else weights[:, None]
    count = by_row(u.words, np.bincount(u.owner, minlength=u.n_distinct)[u.distinct])
    out = np.zeros((n, weights.shape[1]))
    for c in range(weights.shape[1]):
        column = weights[:, c]
        out[:, c] = by_row(u.words, np.bincount(u.owner, column[u.bucket], u.n_distinct)[u.distinct])
        for bucket, row in u.pairs:
            out[:, c] += np.bincount(row, column[bucket], n)
    for _, row in u.pairs:
        count += np.bincount(row, minlength=n)
    return out, count


class Rows(NamedTuple):
    """Sparse rows: at[i]:at[i+1] are row i's buckets and what share of its features each has."""

    at: np.ndarray
    bucket: np.ndarray
    share: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = self.at[rows + 1] - self.at[rows]
        at = np.concatenate([[0], np.cumsum(size)])
        i = np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])
        return Rows(at, self.bucket[i], self.share[i])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


#: Texts are taken so many bytes at a time to train on: every word's features are laid out, some 200 bytes for each of text.
ROWS_BYTES = 64 << 10


def rows_of(texts: pa.Array, spec: Spec) -> Rows:
    """Features of a bounded number of texts, to train on."""
    sizes, buckets, shares = bytearray(), bytearray(), bytearray()  # these grow in place: lists of arrays would be there twice
    size = 1 << spec.bits
    for part in slices(texts, ROWS_BYTES):
        u = units(part, spec)
        n = part.last - part.first
        key, times = np.unique(u.words.row() * max(1, u.n_distinct) + u.distinct, return_counts=True)
        row, word = key // max(1, u.n_distinct), key % max(1, u.n_distinct)
        order = np.argsort(u.owner, kind="stable")
        each = np.bincount(u.owner, minlength=u.n_distinct)
        begin = np.cumsum(each) - each
        own = np.repeat(np.arange(len(key)), each[word])
        run = np.arange(len(own)) - np.repeat(np.cumsum(each[word]) - each[word], each[word])
        keys = [row[own] * size + u.bucket[order[begin[word[own]] + run]]]
        counts = [times[own]]
        for bucket, r in u.pairs:
            keys.append(r * size + bucket)
            counts.append(np.ones(len(bucket), np.int64))
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(where, np.concatenate(counts), len(found))
        row = found // size
        all_of = np.bincount(row, count, n)
        sizes += np.bincount(row, minlength=n).astype(np.int64).data
        buckets += (found % size).astype(np.int32).data
        shares += (count / all_of[row]).astype(np.float32).data
    return Rows(np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]), np.frombuffer(buckets, np.int32), np.frombuffer(shares, np.float32))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Bytes of text that a sample holds at most, beside its rows' limit.
SAMPLE_BYTES = 64 << 20


def sample(docs: DataFrame, wanted: DataFrame, label: str, limit: int, per_label: bool = False, most_bytes: int = SAMPLE_BYTES) -> tuple[pa.Array, list]:
    """Texts and labels of at most limit rows of wanted (doc_id, label) and most_bytes of text, those whose ids hash lowest.

    The one place where rows are collected; limit and most_bytes bound them.  Of
    an id's labels that differ the least counts; of an id's texts all may be
    taken.  The order is total, so that every run takes the same rows.  With
    per_label each label has an equal share of limit, so that a rare one is there
    (of more labels than limit, those of the most ids).
    """
    few = wanted.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label_")).withColumn("order_", F.xxhash64("doc_id"))
    if per_label:
        labels = few.groupBy("label_").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label_").limit(limit).collect()
        share = max(1, limit // max(1, len(labels)))
        # A label's rows that may be taken lie below a hash that some four times as many do, so that no task gets all of a frequent one.
        cuts = [(r["label_"], min(2**63 - 1, -(2**63) + 2**64 * (4 * share + 60) // r["n"])) for r in labels]
        cuts = few.sparkSession.createDataFrame(cuts, T.StructType([few.schema["label_"], T.StructField("cut_", T.LongType())]))
        few = few.join(F.broadcast(cuts), "label_").filter(F.col("order_") <= F.col("cut_")).drop("cut_")  # limit rows at most
        ranked = few.withColumn("rank_", F.row_number().over(Window.partitionBy("label_").orderBy("order_", "doc_id")))
        few = ranked.filter(F.col("rank_") <= share).drop("rank_")
    few = few.orderBy("order_", "doc_id").limit(limit)
    got = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").orderBy("order_", "doc_id", "text").limit(limit)
    held = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy("order_", "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = got.withColumn("held_", held).filter(F.col("held_") <= most_bytes).select("doc_id", "text", "label_").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    text = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    return (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text), got.column("label_").to_pylist()


def least_hashed(docs: DataFrame, limit: int, most_bytes: int = SAMPLE_BYTES // 4) -> list[str]:
    """At most limit different texts of docs and most_bytes of them, those that hash lowest.

    Hashes and sizes are ordered first, so that only texts that are taken are moved.
    """
    hashed = docs.filter(F.octet_length("text") > 0).select("text", F.xxhash64("text").alias("order_"))
    lean = hashed.groupBy("order_").agg(F.max(F.octet_length("text")).alias("size")).orderBy("order_").limit(limit).collect()  # limit rows
    held, last = 0, None
    for r in lean:
        held += r["size"]
        if held > most_bytes:
            break
        last = r["order_"]
    if last is None:
        return []
    return sorted(r["text"] for r in hashed.filter(F.col("order_") <= last).select("text").distinct().toLocalIterator())


def batches_of(rows: int, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    order = rng.permutation(rows)
    for i in range(0, rows, size):
        yield order[i : i + size]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def arrays(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
