"""Node similarity and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collections import _guard
from ..graph import PropertyGraph, prop
from ..plans.lineage import dealt, dealt_by_range, written
from ..registry import register


def _shared(g: PropertyGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct out-links, (id, size) and (node1, node2, common) for pairs that share a neighbour."""
    link = written(g.E.select("src", "dst").distinct(), "links")
    # Written, so that a small table of sizes is known to be one and pairs aren't dealt out to meet it.
    size = written(link.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("size")), "sizes")
    part = dealt_by_range(link, link.count(), "dst", "src").mapInArrow(_counted_pairs, "node1 long, node2 long, n long")
    part = written(part, "pairs")
    common = dealt(part, part.count(), "node1", "node2").groupBy("node1", "node2").agg(F.sum("n").alias("common"))
    return link, size, common


#: A task counts about so many pairs at a time.
PAIRS = 2_000_000


def _counted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node1, node2, n): of links (src, dst) dealt out and sorted by dst then src, how often two src have one dst in common, by parts of a task."""

    def settled(pairs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, n = (np.concatenate(c) for c in zip(*pairs, strict=True))
        at = np.lexsort((b, a))
        a, b, n = a[at], b[at], n[at]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return a[new], b[new], np.add.reduceat(n, new)

    def out(pairs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], names=["node1", "node2", "n"])

    src, dst, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        # The last run goes on in the next batch; of it only new links meet those before them.
        old = len(src)
        src, dst = np.concatenate([src, batch.column("src").to_numpy()]), np.concatenate([dst, batch.column("dst").to_numpy()])
        begin = np.searchsorted(dst, dst)
        count = np.arange(len(src)) - begin
        count[:old] = 0
        upto = np.cumsum(count)
        lo = 0
        while lo < len(src):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
            c = count[lo:hi]
            second = np.repeat(np.arange(lo, hi), c)
            first = np.repeat(begin[lo:hi], c) + np.arange(len(second)) - np.repeat(np.cumsum(c) - c, c)
            if len(second):
                held.append((src[first], src[second], np.ones(len(second), np.int64)))
                size += len(second)
            lo = hi
            if size >= 2 * PAIRS:
                held = [settled(held)]
                size = len(held[0][0])
                if size > PAIRS:
                    yield out(held[0])
                    held, size = [], 0
        last = begin[-1] if len(src) else 0
        src, dst = src[last:], dst[last:]
    if held:
        yield out(settled(held))


def _all_pairs(g: PropertyGraph) -> DataFrame:
    """Every unordered pair of vertices, the operator's result by definition: n * (n - 1) / 2 rows."""
    v = g.V.select(F.col("id").alias("node1"))
    return v.join(g.V.select(F.col("id").alias("node2")), F.col("node1") < F.col("node2"))


def _sized(pairs: DataFrame, size: DataFrame) -> DataFrame:
    for k in ("1", "2"):
        pairs = pairs.join(size.select(F.col("id").alias(f"node{k}"), F.col("size").alias(f"size{k}")), f"node{k}", "left")
    return pairs.fillna(0, ["common", "size1", "size2"])


def _jaccard() -> Column:
    either = F.col("size1") + F.col("size2") - F.col("common")
    return F.when(either == 0, 0.0).otherwise(F.col("common") / either).alias("similarity")


def _overlap() -> Column:
    least = F.least("size1", "size2")
    return F.when(least == 0, 0.0).otherwise(F.col("common") / least).alias("similarity")


def _of_all(g: PropertyGraph, measure: Column, zeros: bool) -> DataFrame:
    _, size, common = _shared(g)
    pairs = _all_pairs(g).join(common, ["node1", "node2"], "left") if zeros else common
    return _sized(pairs, size).select("node1", "node2", measure)


@register("node_similarity.jaccard")
def jaccard(g: PropertyGraph, zeros: bool = True) -> DataFrame:
    """(node1, node2, similarity) of distinct out-neighbours; without zeros only pairs that share one, which scales with those."""
    return _of_all(g, _jaccard(), zeros)


@register("node_similarity.overlap")
def overlap(g: PropertyGraph, zeros: bool = True) -> DataFrame:
    return _of_all(g, _overlap(), zeros)


def _given(g: PropertyGraph, src_nodes: list[int], dst_nodes: list[int]) -> DataFrame:
    if len(src_nodes) != len(dst_nodes):
        raise ValueError("the node lists differ in length")
    return g.spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(src_nodes, dst_nodes, strict=True))], "i int, node1 long, node2 long")


def _of_given(g: PropertyGraph, src_nodes: list[int], dst_nodes: list[int], measure: Column) -> DataFrame:
    pairs = _given(g, src_nodes, dst_nodes)
    link = g.E.select("src", "dst").distinct()
    size = link.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    one = pairs.join(link.withColumnRenamed("src", "node1"), "node1")
    common = one.join(link.withColumnRenamed("src", "node2"), ["node2", "dst"]).groupBy("i").agg(F.count(F.lit(1)).alias("common"))
    return _sized(pairs.join(common, "i", "left"), size).select("node1", "node2", measure)


@register("node_similarity.jaccard_pairwise")
def jaccard_pairwise(g: PropertyGraph, src_nodes: list[int], dst_nodes: list[int]) -> DataFrame:
    return _of_given(g, src_nodes, dst_nodes, _jaccard())


@register("node_similarity.overlap_pairwise")
def overlap_pairwise(g: PropertyGraph, src_nodes: list[int], dst_nodes: list[int]) -> DataFrame:
    return _of_given(g, src_nodes, dst_nodes, _overlap())


def _vectors(g: PropertyGraph, name: str) -> DataFrame:
    p = prop(g.V, name)
    kind = dict(g.V.select(p.alias("p")).dtypes)["p"]
    p = F.from_json(p, "array<double>") if kind == "string" else p.cast("array<double>")
    return g.V.select("id", _guard(p.isNotNull(), p, f"a node has no {name}").alias("v"))


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return _guard(F.size(a) == F.size(b), F.when(norm < 1e-9, 0.0).otherwise(dot(a, b) / norm), "vectors differ in size")


PAIR_BLOCK = 2048  # vectors of a block whose pairs go out
STRIP = 256  # of a block's vectors, so many meet the other block at once


_PAIR = pa.schema([("node1", pa.int64()), ("node2", pa.int64()), ("similarity", pa.float64())])


def _sides(t: pa.Table, columns: list[str]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids in order, matrices of their vectors) of both of a pair of blocks."""
    t, out = t.sort_by([("id", "ascending")]), []
    for side in (0, 1):
        part = t.filter(pc.equal(t.column("side"), side)).combine_chunks()
        flat = [pc.list_flatten(part.column(c)).to_numpy() for c in columns]
        out.append((part.column("id").to_numpy(), [x.reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, 0)) for x in flat]))
    return out


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of each row of a with each of b, 0 where a length is next to nothing."""
    size = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    return np.where(size < 1e-9, 0.0, (a @ b.T) / np.maximum(size, 1e-300))


@register("node_similarity.cosine")
def cosine(g: PropertyGraph, property: str) -> DataFrame:  # noqa: A002
    """(node1, node2, similarity) of every two nodes, by blocks of a matrix product; rows go out as they are made."""
    v = written(_vectors(g, property), "vectors")
    if v.select(F.size("v").alias("n")).distinct().limit(2).count() > 1:
        raise ValueError("vectors differ in size")
    blocks = max(1, -(-v.count() // PAIR_BLOCK))
    packed = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = packed.select(F.col("b").alias("lb"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("rb"), F.lit(0).alias("side"), "id", "v")
    right = packed.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("lb"), F.col("b").alias("rb"), F.lit(1).alias("side"), "id", "v")

    def run(t: pa.Table) -> pa.Table:
        (a, ua), (b, ub) = _sides(t, ["v"])
        own, out = t.column("lb")[0] == t.column("rb")[0], []
        for i in range(0, len(a) if len(b) else 0, STRIP):
            value = _cosines(ua[0][i : i + STRIP], ub[0])
            first, second = np.broadcast_to(a[i : i + STRIP, None], value.shape), np.broadcast_to(b, value.shape)
            # A block meets itself too; then each pair goes out once.
            keep = first < second if own else np.ones(value.shape, bool)
            n1, n2 = first[keep], second[keep]
            out.append(pa.RecordBatch.from_arrays([pa.array(np.minimum(n1, n2)), pa.array(np.maximum(n1, n2)), pa.array(value[keep])], names=["node1", "node2", "similarity"]))
        return pa.Table.from_batches(out, _PAIR)

    return left.union(right).groupBy("lb", "rb").applyInArrow(run, "node1 long, node2 long, similarity double")


@register("node_similarity.cosine_pairwise")
def cosine_pairwise(g: PropertyGraph, property: str, src_nodes: list[int], dst_nodes: list[int]) -> DataFrame:  # noqa: A002
    v, pairs = _vectors(g, property), _given(g, src_nodes, dst_nodes)
    both = pairs.join(v.select(F.col("id").alias("node1"), F.col("v").alias("a")), "node1").join(v.select(F.col("id").alias("node2"), F.col("v").alias("b")), "node2")
    return both.select("node1", "node2", _cosine(F.col("a"), F.col("b")).alias("similarity"))


BLOCK = 4096  # vectors of a block: two blocks and a strip's products take some 100 MB at 384 dimensions
_NEAR = pa.schema([("node", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])


@register("knn.get")
def knn(g: PropertyGraph, config: dict) -> DataFrame:
    """(node, neighbour, similarity): the topK most similar nodes of each, exactly, by blocks of a matrix product.

    Similarity is the mean over nodeProperties of (cosine + 1) / 2; ties go to
    the lesser id.  Blocks meet pairwise, and a block pair gives topK rows a
    vector at most, so that what is shuffled is blocks * topK rows a vector.
    """
    names = config.get("nodeProperties")
    names = [names] if isinstance(names, str) else list(names or [])
    top, cut = int(config.get("topK", 1)), float(config.get("similarityCutoff", 0.0))
    if not names or top < 1 or not 0 <= cut <= 1 or config.get("randomSeed") == 0 or not 0 <= config.get("sampleRate", 0.5) <= 1:
        raise ValueError("knn needs nodeProperties, a positive topK, a similarityCutoff and sampleRate within 0 and 1, and a randomSeed other than 0")
    n = g.V.count()
    blocks = max(1, -(-n // BLOCK))
    table = None
    for i, name in enumerate(names):
        own = _vectors(g, name).withColumnRenamed("v", f"v{i}")
        table = own if table is None else table.join(own, "id")
    packed = table.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    columns = [f"v{i}" for i in range(len(names))]
    left = packed.select(F.col("b").alias("lb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"), F.lit(0).alias("side"), "id", *columns)
    right = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("lb"), F.col("b").alias("rb"), F.lit(1).alias("side"), "id", *columns)

    def run(t: pa.Table) -> pa.Table:
        (a, ua), (b, ub) = _sides(t, columns)
        k, out = min(top, len(b)), []
        for i in range(0, len(a) if k else 0, STRIP):
            total = np.zeros((len(a[i : i + STRIP]), len(b)))
            for ma, mb in zip(ua, ub, strict=True):
                size = np.outer(np.linalg.norm(ma[i : i + STRIP], axis=1), np.linalg.norm(mb, axis=1))
                total += np.where(size < 1e-9, 0.0, ((ma[i : i + STRIP] @ mb.T) / np.maximum(size, 1e-300) + 1) / 2)
            total /= len(columns)
            total[a[i : i + STRIP, None] == b[None, :]] = -1
            # Whatever may round to the k-th value is looked at; of equals the lesser ids stay.
            least = np.partition(total, len(b) - k, axis=1)[:, len(b) - k, None]
            row, at = np.nonzero(total >= least - 2e-12)
            value = total[row, at]
            order = np.lexsort((at, -np.round(value, 12), row))
            row, at, value = row[order], at[order], value[order]
            first = np.searchsorted(row, row)
            keep = (np.arange(len(row)) - first < k) & (value >= cut)
            out.append(pa.RecordBatch.from_arrays([pa.array(a[i + row[keep]]), pa.array(b[at[keep]]), pa.array(value[keep])], names=["node", "neighbour", "similarity"]))
        return pa.Table.from_batches(out, _NEAR)

    found = left.union(right).groupBy("lb", "rb").applyInArrow(run, "node long, neighbour long, similarity double")
    from pyspark.sql import Window

    w = Window.partitionBy("node").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("rank")


@register("nxalg.jaccard_coefficient")
def jaccard_coefficient(g: PropertyGraph, ebunch: list[tuple[int, int]] | None = None) -> DataFrame:
    """(u, v, coef) on the simple undirected view, for given pairs or for all that aren't edges."""
    link = written(g.undirected().select("src", "dst").filter("src <> dst").distinct(), "links")
    h = PropertyGraph(g.V, link)
    if ebunch is not None:
        out = jaccard_pairwise(h, [a for a, _ in ebunch], [b for _, b in ebunch])
    else:
        out = jaccard(h).join(link.select(F.col("src").alias("node1"), F.col("dst").alias("node2")), ["node1", "node2"], "left_anti")
    return out.select(F.col("node1").alias("u"), F.col("node2").alias("v"), F.col("similarity").alias("coef"))
