"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

The plan is made over the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus is: best-fit decreasing takes whole
groups of equal sequences at a time.  A plan entry says that the pieces of one
length whose ranks are first..first+count-1 lie, ``per`` to a sequence, from
one offset of consecutive sequences.  Pieces then find their entry by a join on
length and rank.  Nothing else is collected.  Ranks come from counts by (task,
length): while those are small enough to be broadcast no piece is shuffled, and
beyond that pieces are dealt out by (task, length), of which none has more than
one task's.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
# The splitting rule of byte-level BPE; a fixed value that must equal the vocabulary's own.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBE = ("It's  a probe,\n\n\tof 1234 ways\r\n -- né ÜBER 日本語 \U0001f600!  ", "", " ", "a" * 40 + " b c")


def _bytes_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: itself where printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_by_rank(own: Tokenizer, spec: dict) -> bool:
    """Whether merging by least id is what the file's merges say.

    That holds where ids follow the merges' order and each token is what merging
    its own bytes gives: two parts that form a token's bytes without being its
    merge can then never stand side by side, as the same bytes alone would have
    been merged alike.
    """
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ids = [vocab[a + b] for a, b in pairs]
    plain = spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return plain and all(x < y for x, y in zip(ids, ids[1:], strict=False)) and all([t.id for t in own.model.tokenize(k)] == [i] for k, i in vocab.items())


class Encoder:
    """Ids of the tokenizer file at path.

    tiktoken, which takes a quarter of the time, is used where it must give the
    same ids: the file splits texts as byte-level BPE does by default, changes
    nothing else, and merges_by_rank() holds.  That SPLIT splits every code point
    so is tested.  Texts with special tokens' strings go to the file's own
    tokenizer, as does everything for other files.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        split = spec.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
        if usual and merges_by_rank(self.own, spec):
            import tiktoken

            to_byte = _bytes_of()
            ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _own(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self._own(text)
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each process."""
    return Encoder(path)


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Only a longer document is cut: full pieces, the first of which may be shorter."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, nth long"


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ids (little-endian unsigned 32-bit), and its rank among its task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("task", pa.int32()), ("nth", pa.int64())])
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(names), 1000):
                rows: list[tuple] = []
                for name, text in zip(names[at : at + 1000], texts.slice(at, 1000).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    start = 0
                    for piece, length in enumerate(piece_lengths(len(ids), capacity)):
                        rows.append((name, piece, start, length, ids[start : start + length].tobytes() if keep_ids else None, task, int(seen[length])))
                        seen[length] += 1
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Equal sequences form a group (first sequence, sequences); groups are held by
    what room they have left.  Each length splits one group at most and opens two
    at most, so that there are under 3 * capacity groups, and a sequence has
    under 64 distinct lengths: the plan has under 200 * capacity rows.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                insort(rooms, left)
            room.setdefault(left, []).append((first, n))

    def fill(length: int, rank: int, pieces: int, first: int, left: int) -> None:
        """Put pieces into sequences from first on; each has left room."""
        per = left // length
        out.append((length, rank, pieces, first, per, capacity - left))
        full, rest = divmod(pieces, per)
        put(left - per * length, first, full)
        if rest:
            put(left - rest * length, first + full, 1)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, total = 0, counts[length]
        while rank < total and (i := bisect_left(rooms, length)) < len(rooms):
            left = rooms[i]
            first, n = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(i)
            take = min(total - rank, n * (left // length))
            used = -(-take // (left // length))
            put(left, first + used, n - used)
            fill(length, rank, take, first, left)
            rank += take
        if rank < total:
            fill(length, rank, total - rank, opened, capacity)
            opened += -(-(total - rank) // (capacity // length))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, carry: dict[str, Column] | None = None) -> DataFrame:
    """Pack every document of docs (doc_id, text, ...) into sequences of at most capacity tokens.

    Returns doc_id, piece, start, length, sequence_id, offset and what carry
    makes of a written piece: by default ids (binary, little-endian unsigned
    32-bit).  With an empty carry ids aren't kept.  A null or empty text is the
    one token end_id.  Equal rows are packed each; a null doc_id stays null; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    carry = {"ids": F.col("ids")} if carry is None else carry
    pieces = written(spark, tokenise(docs, tokenizer, capacity, end_id, bool(carry)), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = written(spark, by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = list(zip(*plan(counts, capacity), strict=True)) or [[]] * 6
    columns = [("length", pa.int32()), ("first", pa.int64()), ("pieces", pa.int64()), ("sequence", pa.int64()), ("per", pa.int64()), ("base", pa.int64())]
    slots = spark.createDataFrame(pa.table({k: pa.array(c, t) for (k, t), c in zip(columns, rows, strict=True)}))
    lean = pieces.select("doc_id", "piece", "start", "length", "task", "nth", *(c.alias(k) for k, c in carry.items()))
    ranked = lean.join(by_task.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan's size is bounded by the capacity alone, see plan().
    joined = ranked.join(F.broadcast(slots.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces")))
    i = F.col("rank") - F.col("first")
    return joined.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
        (F.col("sequence") + F.floor(i / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("base") + (i % F.col("per")) * F.col("length")).cast("long").alias("offset"),
        *carry,
    )
