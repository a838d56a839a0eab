"""Repeated byte strings by longest-previous-factor arrays, over a corpus of any size.

What is sought are the starts of strings ("windows") of ``need`` bytes that
also start elsewhere.  Equal windows hold the same least-hashed k-gram at the
same place, so the windows of a text fall into runs by that k-gram (the run's
key), and only runs of one key can share windows:

* runs that are equal as a whole are found by counting 128-bit digests;
* runs of a key that differ go, as bytes, to one task, where suffix order, the
  longest-common-prefix array and the previous and next smaller positions give
  each window's longest previous factor (and, reversed, its longest next one);
* the runs of a key with very many different runs are cut into blocks of
  windows, whose common part is their key, and those go the same way; in the
  last resort blocks are single windows, for which counting digests is all.

Counts are summed before they are shuffled, copies of frequent runs aren't
shuffled to be joined, and other hot keys are only met in joins that Spark may
split.  Texts aren't shuffled: rows are known by file and row
number, and each pass over the corpus reads what concerns its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import new_path, written
from .textbatch import _U, POWERS, digests, flat, mix, prefix, slices, spans_hash

NEED, GRAM = 400, 64
BLOCK = 32  # windows of a block
CROWD = 128  # different runs of a key that one task takes
OFTEN, OFTEN_KEYS = 1000, 10_000  # from so many copies on a run is frequent, if so few can be
ROWS_A_FOLDER = 1 << 17
ORDER_BYTES = 1 << 20  # of text in one suffix order
UNITS = "key long, unit long, mark long, doc_id long, f long, r long, lo long, hi long, at long"


# ---- longest previous factors -------------------------------------------------


def prefix_ranks(data: np.ndarray, need: int) -> dict[int, np.ndarray]:
    """For each power of two from 8 below need on, every position's rank among the strings of that length."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for j in range(8):
        key |= padded[j : j + n] << _U(56 - 8 * j)
    ranks, size = {8: np.unique(key, return_inverse=True)[1].astype(np.int64)}, 8
    while size * 2 <= need:
        r = ranks[size]
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = r[size:] + 1
        size *= 2
        ranks[size] = np.unique(r * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
    return ranks


def common_prefix(data: np.ndarray, ranks: dict[int, np.ndarray], x: np.ndarray, y: np.ndarray, need: int) -> np.ndarray:
    """Length of the longest common prefix of the strings at x and y, need at most."""
    out, n = np.zeros(len(x), np.int64), len(data)
    for size in sorted(ranks, reverse=True):
        i, j = x + out, y + out
        fits = (i < n) & (j < n) & (out + size <= need)
        same = np.zeros(len(x), bool)
        same[fits] = ranks[size][i[fits]] == ranks[size][j[fits]]
        out += size * same
    for _ in range(need % 8 + 8):
        i, j = x + out, y + out
        fits = np.flatnonzero((i < n) & (j < n) & (out < need))
        same = fits[data[i[fits]] == data[j[fits]]]
        if not len(same):
            break
        out[same] += 1
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of the need bytes there (equal ones by place), and each one's common prefix with the one before."""
    ranks = prefix_ranks(data, need)
    top = max(ranks)
    last = np.minimum(starts + (need - top), len(data) - 1)
    order = starts[np.lexsort((starts, ranks[top][last], ranks[top][starts]))]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefix(data, ranks, order[:-1], order[1:], need)
    return order, lcp


def _smaller(sa: np.ndarray, lcp: np.ndarray, need: int) -> np.ndarray:
    """Length of the match with the previous smaller position in suffix order; 0 where it falls below need."""
    p, m = np.arange(len(sa)) - 1, lcp.copy()
    open_ = np.flatnonzero((p >= 0) & (m >= need))
    while len(open_ := open_[sa[p[open_]] > sa[open_]]):
        m[open_] = np.minimum(m[open_], lcp[p[open_]])
        p[open_] -= 1
        open_ = open_[(p[open_] >= 0) & (m[open_] >= need)]
    return np.where((p >= 0) & (m >= need), m, 0)


def longest_previous(sa: np.ndarray, lcp: np.ndarray, need: int) -> np.ndarray:
    """Longest previous factor of each suffix in suffix order: the better match of the previous and next smaller positions."""
    flipped = np.zeros(len(sa), np.int64)
    flipped[1:] = lcp[:0:-1]
    return np.maximum(_smaller(sa, lcp, need), _smaller(sa[::-1], flipped, need)[::-1])


def repeated_starts(data: np.ndarray, starts: np.ndarray, need: int, keep: str) -> np.ndarray:
    """Which of starts have the need bytes there also at another of them: an earlier one (keep first) or any (keep none)."""
    if not len(starts):
        return np.zeros(0, bool)
    sa, lcp = suffix_order(data, starts, need)
    hit = longest_previous(sa, lcp, need) >= need
    if keep == "none":
        hit |= longest_previous(-sa, lcp, need) >= need
    out = np.zeros(len(data) + 1, bool)
    out[sa[hit]] = True
    return out[starts]


# ---- runs ----------------------------------------------------------------------


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of width values the place of its least one, the first of equals."""
    n, place, size = len(h) - width + 1, np.arange(len(h)), 1
    while size * 2 <= width:
        a, b = place[:-size], place[size:]
        place, size = np.where(h[b] < h[a], b, a), size * 2
    a, b = place[:n], place[width - size : width - size + n]
    return np.where(h[b] < h[a], b, a)


def gram_hashes(pre: np.ndarray, size: int) -> np.ndarray:
    return mix((pre[size:] - pre[:-size]) * POWERS.to(len(pre))[1][: len(pre) - size])


def runs(data: np.ndarray, offs: np.ndarray, need: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, unit, mark, row, lo, hi, at) of each run: windows lo..hi of its row, whose k-gram is at at; places are in data.

    unit and mark are the digest of the run's bytes.
    """
    if len(data) < need:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    h = gram_hashes(prefix(data), gram)
    place = least_places(h, need - gram + 1)
    start = np.arange(len(place))
    row = np.searchsorted(offs, start, "right") - 1
    inside = start + need <= offs[row + 1]
    start, place, row = start[inside], place[inside], row[inside]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    lo, hi = start[first], np.append(start[first[1:] - 1], start[-1])
    return h[place[first]].view(np.int64), *digests(data, lo, hi + need).T, row[first], lo, hi, place[first]


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_UNITS = pa.schema([(c.split()[0], pa.int64()) for c in UNITS.split(", ")])


def run_table(docs: DataFrame, need: int, gram: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, f, r = (np.asarray(batch.column(c)) for c in ("rank_", "f", "r"))
            for part in slices(batch.column("text"), 1 << 20):
                key, unit, mark, row, lo, hi, at = runs(part.data, part.offs, need, gram)
                base, row = part.offs[row], row + part.first
                yield _batch([key, unit, mark, ids[row], f[row], r[row], lo - base, hi - base, at - base], _UNITS)

    return docs.select("rank_", "f", "r", "text").mapInArrow(work, UNITS)


# ---- passes over the corpus that look things up by row -----------------------------


def by_place(spark: SparkSession, table: DataFrame, label: str) -> str:
    """Write table (f, r, ...) into a folder for each stretch of a file's rows; the path."""
    path = new_path(spark, label)
    placed = table.withColumn("g", F.floor(F.col("r") / ROWS_A_FOLDER).cast("long"))
    placed.repartition("f", "g").write.partitionBy("f", "g").option("compression", "zstd").parquet(path)
    return path


class Placed:
    """What by_place() wrote, sorted by row; one folder is held at a time."""

    def __init__(self, path: str, columns: list[str]) -> None:
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(path)
        self.columns, self.held, self.at, self.table = columns, None, np.zeros(0, np.int64), None

    def _load(self, f: int, g: int) -> None:
        from pyarrow import fs

        self.held = (f, g)
        found = self.store.get_file_info(fs.FileSelector(f"{self.base}/f={f}/g={g}", allow_not_found=True))
        parts = [pq.read_table(self.store.open_input_file(x.path), columns=["r", *self.columns]) for x in found if x.path.endswith(".parquet")]
        self.at, self.table = np.zeros(0, np.int64), None
        if parts:
            table = pa.concat_tables(parts).sort_by([("r", "ascending")])
            self.at, self.table = table.column("r").to_numpy(), [table.column(c).to_numpy() for c in self.columns]

    def __call__(self, f: int, r: int) -> list[np.ndarray] | None:
        if self.held != (f, r // ROWS_A_FOLDER):
            self._load(f, r // ROWS_A_FOLDER)
        a, b = np.searchsorted(self.at, [r, r + 1])
        return [c[a:b] for c in self.table] if a < b else None


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(rank, f, r, bytes) of each row."""
    data, offs = flat(batch.column("text"))
    ids, f, r = (np.asarray(batch.column(c)).tolist() for c in ("rank_", "f", "r"))
    for i in range(len(r)):
        yield ids[i], f[i], r[i], data[offs[i] : offs[i + 1]]


def block_table(docs: DataFrame, asked: str, need: int, size: int) -> DataFrame:
    """The blocks of size windows, by place from the run's k-gram, of the runs asked for: a block's key is what all its windows share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Placed(asked, ["lo", "hi", "at"])
        for batch in batches:
            for name, f, r, data in _rows(batch):
                if (found := look(f, r)) is None:
                    continue
                lo, hi, at = (np.asarray(x, np.int64) for x in found)
                first, last = (lo - at) // size, (hi - at) // size
                n = last - first + 1
                own = np.repeat(np.arange(len(lo)), n)
                k = np.repeat(first, n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                a, b = np.maximum(lo[own], at[own] + k * size), np.minimum(hi[own], at[own] + k * size + size - 1)
                start = at[own] + k * size  # of a whole block; at a run's ends a block may have fewer windows, but the same key
                key = mix(spans_hash(data, start + size - 1, start + need) + mix((k + need).astype(_U)))
                unit, mark = digests(data, a, b + need).T
                unit = unit ^ mix(((a - start) * size + b - a).astype(_U)).view(np.int64)  # where in the block it lies
                same = np.full(len(a), 1, np.int64)
                yield _batch([key.view(np.int64), unit, mark, name * same, f * same, r * same, a, b, at[own]], _UNITS)

    return docs.select("rank_", "f", "r", "text").mapInArrow(work, UNITS)


_PIECES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("f", pa.int64()), ("r", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("bytes", pa.binary())])


def piece_table(docs: DataFrame, asked: str, need: int) -> DataFrame:
    """The bytes of the runs asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Placed(asked, ["key", "lo", "hi"])
        for batch in batches:
            rows: list[tuple] = []
            for name, f, r, data in _rows(batch):
                if (found := look(f, r)) is not None:
                    rows += [(k, name, f, r, a, b, data[a : b + need].tobytes()) for k, a, b in zip(*(x.tolist() for x in found), strict=True)]
            for i in range(0, len(rows), 2000):
                yield _batch(list(zip(*rows[i : i + 2000], strict=True)), _PIECES)

    return docs.select("rank_", "f", "r", "text").mapInArrow(work, "key long, doc_id long, f long, r long, lo long, hi long, bytes binary")


def compare(pieces: DataFrame, need: int, keep: str) -> DataFrame:
    """(f, r, lo, hi) of the windows of pieces that repeat; the pieces of a key are in one task, CROWD at most.

    Whole keys are put into one suffix order up to ORDER_BYTES: windows of
    different keys differ anyway.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("f", "r", "lo", "hi")])

    def solve(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=lambda x: (x["doc_id"], x["f"], x["r"], x["lo"]))
        data = np.frombuffer(b"".join(x["bytes"] for x in rows), np.uint8)
        size = np.array([len(x["bytes"]) for x in rows])
        base = np.cumsum(size) - size
        n = size - need + 1
        own = np.repeat(np.arange(len(rows)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        hit = repeated_starts(data, base[own] + place, need, keep)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        # A hit stretch that crosses pieces is cut where the next one begins.
        cut = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
        first = np.flatnonzero(hit & ((edge[:-1] == 1) | cut))
        last = np.flatnonzero(hit & ((edge[1:] == -1) | np.append(cut[1:], True)))
        lo = np.array([x["lo"] for x in rows])[own[first]]
        return _batch([[rows[i]["f"] for i in own[first]], [rows[i]["r"] for i in own[first]], lo + place[first], lo + place[last]], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, key = [], 0, None
        for batch in batches:
            for x in batch.to_pylist():
                if held >= ORDER_BYTES and x["key"] != key:
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(x)
                held, key = held + len(x["bytes"]), x["key"]
        if rows:
            yield solve(rows)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(work, "f long, r long, lo long, hi long")


# ---- the whole -----------------------------------------------------------------------


def _settle(spark: SparkSession, units: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """(f, r, lo, hi) of units that repeat as a whole, and one row of each different unit of keys that have several: with crowd, their number."""
    place = ["doc_id", "f", "r", "lo", "hi", "at"]
    if keep == "first":
        grouped = units.groupBy("key", "unit", "mark").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("s")).select("key", "unit", "mark", "n", "s.*")
    else:
        grouped = units.groupBy("key", "unit", "mark").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in place])
    # Written, so that first() is settled once and joins have plain exchanges on both sides.
    grouped = written(spark, grouped, "units")
    several = written(spark, grouped.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"), "several")
    mixed = grouped.join(several, "key").select("key", *place, "crowd")
    run = ["key", "unit", "mark"]
    twice = grouped.filter("n > 1").select(*run, "n", *[F.col(c).alias(f"first_{c}") for c in ("f", "r", "lo")])
    # More than total / OFTEN_KEYS copies: that holds for fewer than OFTEN_KEYS runs.
    often = F.col("n") > max(OFTEN, units.count() // OFTEN_KEYS)
    frequent = twice.filter(often)
    if frequent.isEmpty():
        whole = units.join(twice, run)
    else:
        # The copies of a frequent run stay where they are read, as by run they would all be dealt to one task.
        rest = units.join(F.broadcast(frequent.select(*run)), run, "left_anti").join(twice.filter(~often), run)
        whole = units.join(F.broadcast(frequent), run).unionByName(rest)
    if keep == "first":
        whole = whole.filter((F.col("f") != F.col("first_f")) | (F.col("r") != F.col("first_r")) | (F.col("lo") != F.col("first_lo")))
    return whole.select("f", "r", "lo", "hi"), written(spark, mixed, "mixed")


def _located(docs: DataFrame) -> DataFrame:
    """docs with f and r (file and row), and rank_ (doc_id, by which copies are ordered); docs that aren't files are written first."""

    def named(df: DataFrame) -> DataFrame:
        names = [F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")]
        return df.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rank_"), *names)

    try:
        return named(docs)
    except AnalysisException:
        return named(written(docs.sparkSession, docs, "docs"))


def remove_repeats(docs: DataFrame, need: int = NEED, gram: int = GRAM, keep: str = "first") -> DataFrame:
    """docs without text, with n_bytes, spans (removed byte ranges: start, end) and kept (the other bytes, concatenated).

    A byte goes if a string of need bytes over it also starts elsewhere in the
    corpus, the same text included: earlier (keep "first"; order is by doc_id,
    then place), or anywhere (keep "none").  Strings are judged on the input.
    Matches never cross rows.  A null text is empty; a very long one is held
    whole by one task, some 60 bytes for each of its own; repeated rows are
    copies of each other; other columns stay, those with clashing names are replaced; an
    empty table gives an empty result.
    """
    if keep not in ("first", "none") or not 8 <= gram <= need:
        raise ValueError("keep is first or none, and gram from 8 to need")
    spark = docs.sparkSession
    docs = _located(docs.drop("n_bytes", "spans", "kept", "f", "r", "rank_", "_metadata"))
    whole, mixed = _settle(spark, written(spark, run_table(docs, need, gram), "runs"), keep)
    found, asked = [whole], [mixed.filter(F.col("crowd") <= CROWD).select("key", "f", "r", "lo", "hi")]
    for size in (BLOCK, 1):
        crowded = mixed.filter(F.col("crowd") > CROWD)
        if crowded.isEmpty():
            break
        blocks = block_table(docs, by_place(spark, crowded.select("f", "r", "lo", "hi", "at"), "crowded"), need, size)
        whole, mixed = _settle(spark, written(spark, blocks, "blocks"), keep)
        found.append(whole)
        if size == 1:
            break
        asked.append(mixed.filter(F.col("crowd") <= CROWD).select("key", "f", "r", "lo", "hi"))
    for wanted in asked:
        if not wanted.isEmpty():
            found.append(compare(piece_table(docs, by_place(spark, wanted, "asked"), need), need, keep))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return _cut(docs, by_place(spark, every, "found"), need)


def _cut(docs: DataFrame, found: str, need: int) -> DataFrame:
    kept = [x for x in docs.schema.fields if x.name not in ("text", "f", "r", "rank_")]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Placed(found, ["lo", "hi"])
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                sizes, spans, rest = [], [], []
                for _, f, r, data in _rows(batch):
                    ranges: list[tuple[int, int]] = []
                    if (hit := look(f, r)) is not None:
                        order = np.argsort(hit[0], kind="stable")
                        start, end = hit[0][order], np.maximum.accumulate(hit[1][order] + need)
                        new = np.concatenate([[True], start[1:] > end[:-1]])
                        ranges = list(zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist(), strict=True))
                    at, parts = 0, []
                    for a, b in ranges:
                        parts.append(data[at:a].tobytes())
                        at = b
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": b} for a, b in ranges])
                    rest.append(b"".join([*parts, data[at:].tobytes()]))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(x.name) for x in kept), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(rest, pa.binary())], names=[*(x.name for x in kept), "n_bytes", "spans", "kept"])

    return docs.mapInArrow(work, T.StructType([*kept, *added]))


def span_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
