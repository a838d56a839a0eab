"""Near-duplicate documents by ProbMinHash, banding, and exact verification.

A document is a weighted set of word shingles.  Each element sends arrivals of
a Poisson process (exponential gaps over its weight) to random registers; a
register keeps the element that arrives first, so that two documents' registers
agree with the probability of their probability Jaccard similarity.  An element
stops once its next arrival is later than every register's.  Documents that
agree on a band of registers meet, and the Jaccard similarity of their whole
shingle sets decides whether they are linked.  A class is what links connect.

Exact copies are folded first.  Members of a band's group are then compared with
leaders, in rounds, which connects most of what is alike cheaply.  Whatever of a
group isn't connected after that is compared all with all, in blocks: every two
documents that share a band are connected in the end, or were compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import scratch, written
from .textbatch import _U, Slice, Words, mix, slices, windows, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 5
SALTS = 32
FEW = 200_000  # rows, of some 24 bytes, that one task takes
BLOCK = 256  # documents of a group on one side of a task
COLUMNS = 4096
FEW_PAIRS = 2000
_STEP = 0x9E3779B97F4A7C15


def shingles(part: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Distinct shingle hashes of each row, in order, how often each occurs, and where rows begin.

    A row of fewer words than a shingle has its whole word sequence as its one
    shingle; one without words has none.
    """
    w = words(part)
    h, at = windows(w, size)
    begin = np.searchsorted(w.row()[at] if len(at) else at, np.arange(len(w.of)))
    found, times = [], []
    for r in range(len(w.of) - 1):
        own = h[begin[r] : begin[r + 1]]
        if not len(own) and w.of[r + 1] > w.of[r]:
            few = w.hash[w.of[r] : w.of[r + 1]]
            own = mix(np.array([np.sum(few * (np.arange(len(few), dtype=_U) * _U(2) + _U(3)), dtype=_U) + _U(len(few))]))
        d, n = np.unique(own, return_counts=True)
        found.append(d)
        times.append(n)
    sizes = np.concatenate([[0], np.cumsum([len(d) for d in found])]).astype(np.int64)
    return np.concatenate(found or [np.zeros(0, _U)]), np.concatenate(times or [np.zeros(0, np.int64)]), sizes, w


def signatures(element: np.ndarray, weight: np.ndarray, of: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: for each row the element that arrives first in each register; 0 for rows without elements.

    The points of an element depend on its hash alone (times over its weight),
    so that rows agree wherever the same element comes first.
    """
    n = len(of) - 1
    best = np.full(n * registers, np.inf)
    first = np.zeros(n * registers, _U)
    row = np.repeat(np.arange(n), np.diff(of))
    time, active, k = np.zeros(len(element)), np.arange(len(element)), 0
    while len(active):
        k += 1
        bits = mix(element[active] + _U((k * _STEP) & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((bits >> _U(11)).astype(float) + 0.5) / 2**53)
        time[active] += gap / weight[active]
        slot = row[active] * registers + (mix(bits + _U(1)) % _U(registers)).astype(np.int64)
        t = time[active]
        np.minimum.at(best, slot, t)
        won = best[slot] == t
        first[slot[won]] = element[active][won]
        last = best.reshape(n, registers).max(1)
        active = active[t <= last[row[active]]]
    return first.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash for each band of a signature's registers; the band's number is part of it."""
    n, registers = signature.shape
    parts = signature.reshape(n, bands, registers // bands)
    h = np.zeros((n, bands), _U)
    for r in range(parts.shape[2]):
        h = mix(h * _U(_STEP) + parts[:, :, r])
    return mix(h + np.arange(bands, dtype=_U))


WEIGHTS = {"binary": lambda n: np.ones(len(n)), "count": lambda n: n.astype(float), "log": lambda n: 1 + np.log(n)}


def sketch(docs: DataFrame, weighting: str = "binary", size: int = SHINGLE) -> DataFrame:
    """For each row of docs (doc_id, text): k1, k2 (128-bit digest of its word sequence; null without words) and bands."""
    weigh = WEIGHTS[weighting]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for part in slices(batch.column("text")):
                element, times, of, w = shingles(part, size)
                bands = band_keys(signatures(element, weigh(times), of)).view(np.int64)
                rows = zip(part.offs[:-1].tolist(), part.offs[1:].tolist(), strict=True)
                own = b"".join(hashlib.blake2b(b" ".join(part.data[a:b].tobytes().split()), digest_size=16).digest() for a, b in rows)
                none = np.diff(of) == 0
                k1, k2 = (pa.array(k, mask=none) for k in np.frombuffer(own, np.int64).reshape(-1, 2).T)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([names.slice(part.first, part.last - part.first), k1, k2, lists], names=["doc_id", "k1", "k2", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and its distinct shingles: sorted unsigned 32-bit halves of their hashes, as bytes.

    With s shingles on either side under s * s / 2**32 of them meet by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("doc_id")
            for part in slices(batch.column("text")):
                element, _, of, _ = shingles(part, size)
                short = (element >> _U(32)).astype("<u4")
                sets = [np.unique(short[a:b]).tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([names.slice(part.first, part.last - part.first), pa.array(sets, pa.binary())], names=["doc_id", "grams"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, grams binary")


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (la, lb, left, right: two shingle sets) those whose Jaccard similarity reaches threshold: la, lb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                ok = min(len(p), len(q)) >= threshold * max(len(p), len(q)) and len(p) > 0
                if ok:
                    both = np.concatenate([p, q])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    ok = common >= threshold * (len(both) - common)
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("la"), batch.column("lb")], names=["la", "lb"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("la", "lb", "left", "right").mapInArrow(run, "la long, lb long")


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each of x has in common with each of y; values are distinct within each."""
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.int64)
    if not len(both):
        return out
    sides = []
    for lists in (x, y):
        flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(v) for v in lists])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = np.flatnonzero(both[at] == flat)
        hit = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[hit], owner[hit], len(lists)))
    for c in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - c)
        dense = []
        for at, owner, n in sides:
            a, b = np.searchsorted(at, [c, c + width])
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], at[a:b] - c] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def compared(table: pa.Table, threshold: float) -> pa.Table:
    """Links (la, lb) between two blocks of a group, or within one: key, side, label, keys, grams.

    Two documents that share several groups are compared in that of the least key.
    """
    key = table["key"][0].as_py()
    side, label = table["side"].to_numpy(), table["label"].to_numpy()
    grams = [np.frombuffer(g.as_buffer(), "<u4") for g in table["grams"]]
    lower = [np.array([k for k in ks if k < key], np.int64) for ks in table["keys"].to_pylist()]
    size = np.array([len(g) for g in grams])
    x, y = np.flatnonzero(~side), np.flatnonzero(side)
    one = not len(y)
    y = x if one else y
    small, large = np.minimum(size[x][:, None], size[y]), np.maximum(size[x][:, None], size[y])
    ask = (label[x][:, None] != label[y]) & (small > 0) & (small >= threshold * large)
    if one:
        ask &= np.triu(np.ones(ask.shape, bool), 1)
    if ask.any():
        ask &= common([lower[i] for i in x], [lower[i] for i in y]) == 0
    rows, columns = np.flatnonzero(ask.any(1)), np.flatnonzero(ask.any(0))
    x, y, ask = x[rows], y[columns], ask[np.ix_(rows, columns)]
    i, j = np.nonzero(ask)
    if len(i) > FEW_PAIRS:
        n = common([grams[a] for a in x], [grams[a] for a in y])[i, j]
    else:
        n = np.array([len(np.intersect1d(grams[x[a]], grams[y[b]], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    found = n >= threshold * (size[x][i] + size[y][j] - n)
    links = np.unique(np.stack([label[x][i][found], label[y][j][found]], 1), axis=0)
    return pa.table({"la": pa.array(links[:, 0], pa.int64()), "lb": pa.array(links[:, 1], pa.int64())})


def remaining_links(spark: SparkSession, groups: DataFrame, sets: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    """Links (la, lb) between any two members of a group that have different labels.

    groups: key, doc_id, label.  Groups of the same members are taken once, those
    of two not at all, as leaders settle them.  A group is cut into blocks, of one
    label where that has so many members, and each two blocks go to a task unless
    they are of one label.
    """
    each = groups.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("mark"), F.min("doc_id").alias("least"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("members"), F.bit_xor("mark").alias("mark"), F.min("least").alias("least"), F.sum(F.when(F.col("n") < size, F.col("n"))).alias("mixed"))
    sizes = sizes.filter("labels > 1 and members > 2").groupBy("members", "mark", "least").agg(F.min(F.struct("key", "mixed")).alias("g")).select("g.*")
    sizes = written(spark, sizes, "stalled")
    rows = groups.join(sizes, "key").join(each.select("key", "label", "n"), ["key", "label"])
    own = F.col("n") >= size
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.when(own, F.col("n")).otherwise(F.col("mixed")) / size))
    block = F.struct(own.alias("own"), F.when(own, F.col("label")).otherwise(0).alias("label"), part.alias("part"))
    rows = written(spark, rows.select("key", "doc_id", "label", block.alias("block")), "stalled")
    blocks = written(spark, rows.select("key", "block").distinct(), "blocks")
    two = blocks.select("key", F.col("block").alias("one")).join(blocks.select("key", F.col("block").alias("two")), "key")
    two = two.filter((F.col("one") <= F.col("two")) & ~(F.col("one.own") & F.col("two.own") & (F.col("one.label") == F.col("two.label"))))
    sides = two.withColumn("block", F.explode(F.array_distinct(F.array("one", "two")))).withColumn("side", F.col("block") != F.col("one"))
    keys = written(spark, rows.groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "keys")
    facts = sets.join(keys, "doc_id")
    laid = rows.join(sides, ["key", "block"]).select("key", "one", "two", "side", "doc_id", "label").join(facts, "doc_id")
    return laid.groupBy("key", "one", "two").applyInArrow(lambda t: compared(t, threshold), "la long, lb long").distinct()


def leader_pairs(groups: DataFrame, rnd: int, salts: int = SALTS) -> DataFrame:
    """Pairs (a, b) of each member and a leader of its group, with their labels la and lb; once for each group.

    groups: key, doc_id, and label of what a document is connected to already.
    With salts, a group is split, each part has a leader of its own, and those
    are compared with one leader; so that no task gets a large group whole.
    Leaders are the least ids first and the least hashes in later rounds.
    """
    order = F.col("doc_id") if rnd == 0 else F.xxhash64(F.lit(rnd), "key", "doc_id")
    member = groups.select("key", F.struct(order.alias("order"), "doc_id", "label").alias("m"))
    if salts > 1:
        salted = member.withColumn("salt", F.pmod(F.xxhash64("m.doc_id", F.lit(rnd)), F.lit(salts)))
        led = salted.withColumn("lead", F.min("m").over(Window.partitionBy("key", "salt")))
        top = led.filter(F.col("m") == F.col("lead")).select("key", "m", F.min("m").over(Window.partitionBy("key")).alias("lead"))
        both = led.select("m", "lead").union(top.select("m", "lead"))
    else:
        both = member.select("m", F.min("m").over(Window.partitionBy("key")).alias("lead"))
    both = both.filter(F.col("lead.label") != F.col("m.label"))
    swap = F.col("lead.doc_id") > F.col("m.doc_id")
    one, two = F.when(swap, F.col("m")).otherwise(F.col("lead")), F.when(swap, F.col("lead")).otherwise(F.col("m"))
    both = both.select(one.alias("one"), two.alias("two"))
    return both.select(F.col("one.doc_id").alias("a"), F.col("two.doc_id").alias("b"), F.col("one.label").alias("la"), F.col("two.label").alias("lb"))


def first_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs (one for each band shared) each later member's with the leader that it meets in most bands."""
    met = pairs.groupBy("a", "b", "la", "lb").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("b").agg(F.max_by(F.struct("a", "la", "lb"), F.struct("n", -F.col("a"))).alias("m")).select("m.a", "b", "m.la", "m.lb")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (la, lb) of pairs; only sets that pairs name are dealt out."""
    asked = lambda c: sets.join(pairs.select(F.col(c).alias("doc_id")).distinct(), "doc_id", "left_semi")
    left = asked("a").select(F.col("doc_id").alias("a"), F.col("grams").alias("left"))
    right = asked("b").select(F.col("doc_id").alias("b"), F.col("grams").alias("right"))
    return similar(right.join(left.join(pairs, "a"), "b"), threshold)


def classes(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "binary", max_rounds: int = 50) -> DataFrame:
    """(doc_id, class_id) for each row of docs (doc_id, text, ...): class_id is the least doc_id of its class.

    Equal word sequences are one class; so are documents linked by a Jaccard
    similarity of threshold or more of their shingle sets, directly or through
    others.  Weights other than binary ones let candidates depend on repeats, which
    the similarity doesn't count.  A row without words is a class of its own, as is one without id
    (whose class_id is null).  Rows of one id that repeat come back each; what
    different texts of one id are linked to is one class.  A very long text is
    held whole by one task, some 100 bytes for each of its own.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    with scratch(spark):
        sketches = written(spark, sketch(docs, weighting), "sketches")
        known = sketches.filter(F.col("doc_id").isNotNull() & F.col("k1").isNotNull())
        firsts = written(spark, known.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")), "firsts")
        kept = known.join(firsts.select("k1", "k2", F.col("first").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
        keyed = kept.select("doc_id", F.explode("bands").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("key")
        keyed = keyed.join(written(spark, shared, "keys"), "key", "left_semi").distinct()
        groups = written(spark, keyed.withColumn("label", F.col("doc_id")), "groups")
        near = _linked(spark, docs, groups, threshold, max_rounds)
        # Every row's class: that of the first of its word sequence.
        of_first = firsts.join(near, firsts["first"] == near["doc_id"], "left").select("k1", "k2", F.coalesce("label", "first").alias("class_id"))
        of_first = written(spark, of_first, "classes")
        found = sketches.select("doc_id", "k1", "k2").join(of_first, ["k1", "k2"], "left")
        found = found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
        return written(spark, found, "near-duplicates", lasting=True)


def _linked(spark: SparkSession, docs: DataFrame, groups: DataFrame, threshold: float, max_rounds: int) -> DataFrame:
    """(doc_id, label: the least doc_id it is connected to by verified links) of the documents in groups.

    A round's links join labels.  The first one compares each document with the
    leader that it meets most often; later ones work on groups that still hold
    several labels, with one member for each label in a group.  A group in which
    that joins nothing is left to remaining_links, as is what max_rounds leaves.
    How many rows there are decides only in how many tasks they are dealt with.
    """
    named = written(spark, groups.select("doc_id", "label").distinct(), "members")
    # A text that repeats under its id gives its set twice, and links that repeat.
    sets = written(spark, shingle_sets(docs.join(named, "doc_id", "left_semi")), "sets", "none")
    if sets.count() > named.count():
        sets = written(spark, sets.distinct(), "sets", "none")
    every = groups.select("key", "doc_id")
    groups = groups.withColumn("labels", F.lit(0))
    for rnd in range(max_rounds):
        pairs = leader_pairs(groups, rnd)
        pairs = written(spark, pairs.distinct() if rnd else first_pairs(pairs), "pairs")
        links = written(spark, verified(pairs, sets, threshold), "links")
        merged = _merged(spark, links)
        named = written(spark, _few(_relabelled(named, merged), named.count()), "members")
        one_each = _relabelled(groups, merged).groupBy("key", "label").agg(F.min_by("doc_id", F.xxhash64("key", "doc_id")).alias("doc_id"), F.max("labels").alias("before"))
        one_each = written(spark, one_each, "labels")
        counted = one_each.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("labels"), F.max("before").alias("before"))
        counted = counted.filter((F.col("labels") > 1) & (F.col("labels") != F.col("before")))
        groups = one_each.select("key", "doc_id", "label").join(counted.select("key", "labels"), "key")
        groups = written(spark, groups, "groups")
        left_over = groups.count()
        if not left_over:
            break
        groups = _few(groups, left_over)
    groups = written(spark, every.join(named, "doc_id"), "groups")
    links = written(spark, remaining_links(spark, groups, sets, threshold), "links")
    return written(spark, _relabelled(named, _merged(spark, links)), "members")


def _merged(spark: SparkSession, links: DataFrame) -> DataFrame:
    merged = connected_components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return written(spark, merged.select(F.col("id").alias("label"), "component"), "merged")


def _relabelled(df: DataFrame, merged: DataFrame) -> DataFrame:
    return df.join(merged, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(1) if rows <= FEW else df


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "binary") -> DataFrame:
    """docs with one row of each class: that of the least doc_id; rows without words or id all stay.

    Where an id repeats, its rows are one document: they stay or go together,
    and of equal ones one stays.  Only the ids that go are joined with docs.
    """
    spark = docs.sparkSession
    with scratch(spark):
        found = classes(docs, threshold, weighting)
        lost = written(spark, found.filter(F.col("class_id") != F.col("doc_id")).select("doc_id").distinct(), "lost", lasting=True)
        again = written(spark, found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "again", lasting=True)
    kept = docs.join(lost, "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    twice = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(twice)
