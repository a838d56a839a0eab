"""Driver loops over graph DataFrames: each round is a declared plan, written so that the next starts from a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lineage import co_located, written


#: So many links, 16 bytes each, are a small part of what any task holds.
FEW_LINKS = 500_000


def _joined_up(links: DataFrame) -> DataFrame:
    """(id, component) of links (src, dst) that one task holds, by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["id", "component"])

    return links.coalesce(1).mapInArrow(run, "id long, component long")


def components(v: DataFrame, e: DataFrame, max_rounds: int = 200, few: int = FEW_LINKS) -> DataFrame:
    """(id, component: the least id reachable when directions are ignored).

    Up to few links are joined up in one task.  Beyond that labels of neighbours
    are taken by partial aggregates, and every second step follows labels to
    their labels, so that long paths need few rounds.  Files of labels are small
    for what they hold, so that the larger are kept from being broadcast.
    """
    links = written(e.select("src", "dst").filter("src <> dst").distinct(), "links")
    ids = v.select("id").distinct()
    if links.count() <= few:
        return ids.join(written(_joined_up(links), "components"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    both = co_located(links.union(links.select("dst", "src")).distinct(), "dst")
    now = written(ids.withColumn("component", F.col("id")), "labels")
    for _ in range(max_rounds):
        offers = both.join(now.hint("merge"), both["dst"] == now["id"]).groupBy("src").agg(F.min("component").alias("offer"))
        near = now.join(offers.hint("merge"), now["id"] == offers["src"], "left").select("id", "component", F.least("component", F.coalesce("offer", "component")).alias("new"))
        near = written(near, "labels")
        jump = near.select(F.col("id").alias("root"), F.col("new").alias("far"))
        nxt = near.join(jump.hint("merge"), near["new"] == jump["root"], "left").select("id", F.col("component").alias("old"), F.least("new", F.coalesce("far", "new")).alias("component"))
        nxt = written(nxt, "labels")
        now = nxt.select("id", "component")
        if nxt.filter("old <> component").isEmpty():
            both.unpersist()
            return now.hint("merge")
    raise RuntimeError(f"components weren't settled within {max_rounds} rounds")


#: Up to so many links a component's kernel holds in a small part of a task's memory, so that nothing is peeled off first.
FEW_PEELED = 100_000


def peel(e: DataFrame, few: int = FEW_PEELED) -> tuple[list[DataFrame], DataFrame]:
    """([(leaf, parent, m) of each round], (a, b, m): links that are left, a < b); m counts the edges between two ends.

    A round takes off each vertex that has one neighbour, of two that have only
    each other the greater.  Only degrees are aggregated and links matched by
    both ends, so that a hub's leaves don't meet in one task.  Rounds end at few
    links, and where they take off less than a tenth (long paths).
    """
    left = written(e.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("m")), "links")
    rounds, size = [], left.count()
    while size > few:
        ends = left.select(F.col("a").alias("leaf"), F.col("b").alias("parent"), "m").union(left.select("b", "a", "m"))
        lone = ends.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"), F.min("m").alias("m")).filter("n = 1")
        pair = lone.select(F.least("leaf", "parent").alias("a"), F.greatest("leaf", "parent").alias("b"), "leaf", "m")
        # A pair that comes from both ends has no other link; its greater end goes.
        off = written(pair.groupBy("a", "b").agg(F.max("leaf").alias("leaf"), F.min("m").alias("m")), "off")
        taken = off.count()
        if taken:
            rounds.append(off.select("leaf", F.when(F.col("leaf") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"), "m"))
            left = written(left.join(off.select("a", "b").hint("shuffle_hash"), ["a", "b"], "left_anti"), "links")
        size -= taken
        if taken * 10 < size + taken:
            break
    return rounds, left


def between(e: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of e whose ends, whichever comes first, are those of links (a, b)."""
    ends = links.select("a", "b").hint("shuffle_hash")
    return e.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(ends, ["a", "b"], "left_semi").drop("a", "b")


def trim(e: DataFrame, few: int = FEW_PEELED) -> DataFrame:
    """(src, dst): distinct links, without self-loops, that may lie on a directed cycle: by rounds, those whose src nothing
    leads to or whose dst leads nowhere go.  Rounds end at few links, and where they take off less than a tenth."""
    left = written(e.select("src", "dst").filter("src <> dst").distinct(), "links")
    size = left.count()
    while size > few:
        # Ends that count are listed once each; a hub's links needn't meet in one task for that.
        entered, leaving = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = written(left.join(entered.hint("merge"), "src", "left_semi").join(leaving.hint("merge"), "dst", "left_semi").select("src", "dst"), "links")
        before, size = size, left.count()
        if (before - size) * 10 < before:
            break
    return left


#: Links that a task looks at together when it reduces them to a forest.
FOREST_LINKS = 1_000_000


def _stars(a: np.ndarray, b: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(vertex, centre, odd) for each vertex of a component but its centre, and whether some vertex is at odds with itself.

    Each vertex is there twice, once for each side; odd links join unlike sides.
    Labels of linked ones are taken by minima, and followed to their labels.
    """
    ids = np.unique(np.concatenate([a, b]))
    x, y = 2 * np.searchsorted(ids, a), 2 * np.searchsorted(ids, b) + odd
    x, y = np.concatenate([x, x + 1]), np.concatenate([y, y ^ 1])
    label = np.arange(2 * len(ids))
    while True:
        apart = label[x] != label[y]
        if not apart.any():
            break
        x, y = x[apart], y[apart]  # labels that are alike stay alike
        p, q = label[x], label[y]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    near = label[0::2]
    off = near != 2 * np.arange(len(ids))
    return ids[off], ids[near[off] >> 1], near[off] & 1, bool((label[0::2] == label[1::2]).any())


def two_sided(e: DataFrame, rows: int = FOREST_LINKS) -> DataFrame:
    """(ok): whether no cycle of edges (src, dst) is odd.

    Tasks reduce links, of which those of near ids are dealt out together, to
    stars that say the same of any two vertices they join; one task joins up the
    stars.  It holds vertices, not edges; the others hold up to rows of either.
    """

    def run(batches: Iterator[pa.RecordBatch], most: int | None = rows) -> Iterator[pa.RecordBatch]:
        held, waiting, bad = tuple(np.zeros(0, np.int64) for _ in range(3)), [], False
        size = 0

        def settle() -> None:
            nonlocal held, waiting, bad, size
            a, b, odd, wrong = _stars(*(np.concatenate(c) for c in zip(held, *waiting, strict=True)))
            held, waiting, bad, size = (a, b, odd), [], bad or wrong, 0

        for batch in batches:
            if bad:
                continue
            waiting.append(tuple(batch.column(c).to_numpy() for c in ("a", "b", "odd")))
            size += batch.num_rows
            if size >= max(rows, len(held[0])):
                settle()
                if most and len(held[0]) > most and not bad:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names=["a", "b", "odd"])
                    held = tuple(np.zeros(0, np.int64) for _ in range(3))
        if waiting and not bad:
            settle()
        if bad:
            held = tuple(np.array([x]) for x in (0, 0, 1))  # at odds with itself wherever it's looked at
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held], names=["a", "b", "odd"])

    schema = "a long, b long, odd long"
    links = written(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("odd")), "links")
    near = links.repartitionByRange(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    stars = written(near.mapInArrow(run, schema), "stars")
    return stars.coalesce(1).mapInArrow(lambda batches: run(batches, None), schema).agg(F.coalesce(F.max(F.when((F.col("a") == F.col("b")) & (F.col("odd") == 1), 1)), F.lit(0)).alias("bad")).select((F.col("bad") == 0).alias("ok"))


def levels(e: DataFrame, seeds: DataFrame, max_depth: int | None = None, keep_seeds: bool = True) -> DataFrame:
    """(id, depth): breadth-first distance from seeds (id) over edges (src, dst); without keep_seeds a seed counts only if reached again."""
    links = co_located(written(e.select("src", "dst").distinct(), "links"), "src")
    front = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "level")
    seen = front if keep_seeds else front.limit(0)
    depth = 0
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        reached = links.join(front, links["src"] == front["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        front = written(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        seen = written(seen.union(front), "seen")
    links.unpersist()
    return seen


def relax(e: DataFrame, seeds: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(source, id, distance, path) of the least sum of weight over edges (src, dst, weight >= 0) from each seed (source, id).

    Bellman-Ford over a frontier of what improved; of equal paths the least in order stays.
    """
    links = co_located(written(e.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "links"), "src")
    start = seeds.select("source", "id", F.lit(0.0).alias("distance"), F.array("id").alias("path"))
    best, front = written(start, "best"), written(start, "front")
    for _ in range(max_rounds):
        step = front.join(links, front["id"] == links["src"]).select("source", F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
        offer = step.groupBy("source", "id").agg(F.min(F.struct("distance", "path")).alias("o")).select("source", "id", "o.*")
        old = best.select("source", "id", F.col("distance").alias("was"))
        front = written(offer.join(old, ["source", "id"], "left").filter("was is null or distance < was").drop("was"), "front")
        if front.isEmpty():
            links.unpersist()
            return best
        best = written(best.join(front, ["source", "id"], "left_anti").union(front), "best")
    raise RuntimeError(f"distances weren't settled within {max_rounds} rounds")


def apply_per_component(v: DataFrame, e: DataFrame, kernel, schema: str, extra: list[Column] | None = None) -> DataFrame:
    """Run kernel(nodes, edges) once per weakly connected component, in parallel.

    nodes: sorted ids; edges: (id, src, dst, weight) tuples by id.  An exact
    sequential algorithm needs its component whole; components are what is
    spread over the cluster.
    """
    parts = components(v, e)
    edges = e.join(parts, e["src"] == parts["id"]).select("component", e["id"].alias("eid"), "src", "dst", *(extra or [F.lit(1.0).alias("weight")]))
    rows = edges.unionByName(parts.select("component", F.lit(None).cast("long").alias("eid"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight")))
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(t: pa.Table) -> pa.Table:
        isv = t.column("dst").is_null()
        nodes = sorted(t.filter(isv).column("src").to_pylist())
        own = t.filter(pc.invert(isv))
        eid, src, dst = (own.column(c).to_numpy() for c in ("eid", "src", "dst"))
        weight = np.nan_to_num(pc.fill_null(own.column("weight"), 1.0).to_numpy(), nan=1.0, posinf=np.inf, neginf=-np.inf)
        at = np.lexsort((eid, dst, src))
        rows = list(kernel(nodes, list(zip(*(c[at].tolist() for c in (eid, src, dst, weight)), strict=True))))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return rows.groupBy("component").applyInArrow(run, schema)
