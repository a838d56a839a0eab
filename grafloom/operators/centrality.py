"""Centrality and link analysis."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import co_located, dealt, written
from ..plans.loops import between, components, peel
from ..registry import register


def _ranks(g: PropertyGraph, edges: DataFrame, rounds: int, damping: float, eps: float, restart: DataFrame | None, redistribute: bool, l1: bool = False) -> DataFrame:
    """Power iteration over edges (src, dst, share: of src's rank that goes along it); (node, rank).

    restart: (id, restart) summing to 1, uniform unless given.  Every round is one
    join on src and one partial aggregate on dst; a round's table holds the rank
    before too, so that the convergence test reads what was written anyway.
    """
    n = g.V.count()
    base = g.V.select("id").withColumn("restart", F.lit(1.0 / n if n else 0.0)) if restart is None else g.V.select("id").join(restart, "id", "left").fillna(0.0, ["restart"])
    now = written(base.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0)).withColumn("was", F.lit(None).cast("double")), "rank")
    edges = written(edges.select("src", "dst", "share"), "shares")
    edges = co_located(edges, "src", edges.count())
    senders = written(edges.select(F.col("src").alias("id")).distinct(), "senders") if redistribute else None
    for _ in range(rounds):
        moved = edges.join(now.select("id", "rank"), edges["src"] == now["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        lost = now.join(senders, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if redistribute else 0.0
        fresh = (1 - damping) * F.col("restart") + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("restart"))
        now = written(now.join(moved, now["id"] == moved["dst"], "left").select("id", "restart", fresh.alias("rank"), F.col("rank").alias("was")), "rank")
        if eps > 0:
            change = F.sum(F.abs(F.col("rank") - F.col("was"))) if l1 else F.max(F.abs(F.col("rank") - F.col("was")))
            moved_by = now.agg(change).first()[0]
            if moved_by is None or (moved_by < n * eps if l1 else moved_by <= eps):
                break
    edges.unpersist()
    return now.select(F.col("id").alias("node"), "rank")


def _shares(g: PropertyGraph, weight: str | None = None) -> DataFrame:
    """Edges with what part of src's weight each carries; parallel edges count each."""
    e = written(g.E.select("src", "dst", g.weight(weight).alias("w") if weight else F.lit(1.0).alias("w")), "edges")
    e = dealt(e, e.count(), "src")
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    return e.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share"))


@register("pagerank.get")
def pagerank(g: PropertyGraph, max_iterations: int = 100, damping_factor: float = 0.85, stop_epsilon: float = 1e-5, num_of_threads: int = 1) -> DataFrame:
    """(node, rank): dangling rank is dropped, and the ranks are divided by their sum at the end."""
    if num_of_threads < 1:
        raise ValueError("num_of_threads must be positive")
    found = _ranks(g, _shares(g), max_iterations, damping_factor, stop_epsilon, None, False)
    total = found.agg(F.sum("rank").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))  # one row


@register("cugraph.pagerank.get")
def pagerank_gpu(g: PropertyGraph, max_iterations: int = 100, damping_factor: float = 0.85, stop_epsilon: float = 1e-5) -> DataFrame:
    return _ranks(g, _shares(g), max_iterations, damping_factor, stop_epsilon / max(1, g.V.count()), None, True, l1=True).withColumnRenamed("rank", "pagerank")


@register("cugraph.personalized_pagerank.get")
def personalized_pagerank(g: PropertyGraph, personalization_vertices: list[int], personalization_values: list[float], max_iterations: int = 100, damping_factor: float = 0.85, stop_epsilon: float = 1e-5, weight_property: str = "weight") -> DataFrame:
    if len(personalization_vertices) != len(personalization_values):
        raise ValueError("vertices and values differ in length")
    total = float(sum(personalization_values))
    restart = g.spark.createDataFrame([(int(v), float(x) / total) for v, x in zip(personalization_vertices, personalization_values, strict=True)], "id long, restart double")
    return _ranks(g, _shares(g, weight_property), max_iterations, damping_factor, stop_epsilon, restart, True).withColumnRenamed("rank", "pagerank")


@register("nxalg.pagerank")
def nx_pagerank(g: PropertyGraph, alpha: float = 0.85, personalization: dict[int, float] | None = None, max_iter: int = 100, tol: float = 1e-6, nstart=None, weight: str | None = "weight", dangling=None) -> DataFrame:
    """(node, rank): dangling rank goes where restarts go; stops when the sum of changes is under tol times the vertices."""
    restart = None
    if personalization:
        total = float(sum(personalization.values()))
        restart = g.spark.createDataFrame([(int(k), v / total) for k, v in personalization.items()], "id long, restart double")
    return _ranks(g, _shares(g, weight), max_iter, alpha, tol, restart, True, l1=True)


@register("igraphalg.pagerank")
def igraph_pagerank(g: PropertyGraph, damping: float = 0.85, weights: str | None = None, directed: bool = True, implementation: str = "prpack") -> DataFrame:
    if implementation not in ("prpack", "arpack"):
        raise ValueError("implementation is prpack or arpack")
    own = g if directed else PropertyGraph(g.V, g.undirected())
    return _ranks(own, _shares(own, weights), 200, damping, 1e-10, None, True)


@register("katz_centrality.get")
def katz(g: PropertyGraph, alpha: float = 0.2, epsilon: float = 1e-2, max_rounds: int = 200) -> DataFrame:
    """(node, rank): sums of alpha**i times the number of walks of length i that end at a node.

    Ends when every two consecutive ranks are epsilon-separated by their bounds;
    a series that doesn't converge within max_rounds raises.
    """
    if g.E.isEmpty():
        return g.V.select(F.col("id").alias("node"), F.lit(0.0).alias("rank"))
    degree = g.E.groupBy("src").count().agg(F.max("count")).first()[0]
    gamma = degree / (1 - alpha * alpha * degree)
    now = written(g.V.select("id", F.lit(1.0).alias("omega"), F.lit(0.0).alias("rank")), "katz")
    e = written(g.E.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "walks")
    for i in range(1, max_rounds + 1):
        got = e.join(now.select("id", "omega"), e["src"] == now["id"]).groupBy("dst").agg(F.sum(F.col("omega") * F.col("n")).alias("got"))
        omega = F.coalesce("got", F.lit(0.0))
        now = written(now.join(got, now["id"] == got["dst"], "left").select("id", omega.alias("omega"), (F.col("rank") + alpha**i * omega).alias("rank")), "katz")
        if _separated(now.withColumn("upper", F.col("rank") + alpha ** (i + 1) * F.col("omega") * gamma), epsilon):
            return now.select(F.col("id").alias("node"), "rank")
    raise ValueError(f"alpha {alpha} gives no convergence within {max_rounds} rounds")


def _separated(df: DataFrame, epsilon: float) -> bool:
    """Whether, from the highest rank down, each one's upper bound lies epsilon below the rank before.

    The order is global, so ranks are first spread over ranges; only each
    range's ends are compared across ranges.
    """
    parts = df.repartitionByRange("rank").sortWithinPartitions(F.desc("rank"), "id").withColumn("p", F.spark_partition_id())
    parts = written(parts.select("p", "rank", "upper", "id"), "ranges")
    w = Window.partitionBy("p").orderBy(F.desc("rank"), "id")
    if not parts.withColumn("before", F.lag("rank").over(w)).filter(F.col("upper") - epsilon >= F.col("before")).isEmpty():
        return False
    ends = parts.groupBy("p").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.max(F.struct("rank", F.negative("id").alias("i"), "upper")).alias("top"))
    rows = sorted(ends.collect(), key=lambda r: -r["high"])  # one row a partition
    return all(b["top"]["upper"] - epsilon < a["low"] for a, b in zip(rows, rows[1:], strict=False))


@register("cugraph.katz_centrality.get")
def katz_classic(g: PropertyGraph, alpha: float = 0.1, beta: float = 1.0, epsilon: float = 1e-6, max_iterations: int = 100, normalized: bool = False) -> DataFrame:
    """(node, katz_centrality): x = alpha A x + beta."""
    now = written(g.V.select("id", F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("was")), "katz")
    e = written(g.E.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "walks")
    for _ in range(max_iterations):
        got = e.join(now.select("id", "x"), e["src"] == now["id"]).groupBy("dst").agg(F.sum(F.col("x") * F.col("n")).alias("got"))
        now = written(now.join(got, now["id"] == got["dst"], "left").select("id", (alpha * F.coalesce("got", F.lit(0.0)) + beta).alias("x"), F.col("x").alias("was")), "katz")
        if epsilon > 0 and (now.agg(F.sum(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0) < epsilon:
            break
    out = now.select(F.col("id").alias("node"), F.col("x").alias("katz_centrality"))
    if normalized:
        norm = out.agg(F.sqrt(F.sum(F.col("katz_centrality") ** 2)).alias("norm"))
        out = out.crossJoin(F.broadcast(norm)).select("node", (F.col("katz_centrality") / F.col("norm")).alias("katz_centrality"))
    return out


@register("cugraph.hits.get")
def hits(g: PropertyGraph, max_iterations: int = 100, tolerance: float = 1e-5, normalized: bool = True) -> DataFrame:
    """(node, hubs, authorities); with normalized each sums to 1, else the largest is 1."""
    e = written(g.E.select("src", "dst").distinct(), "links")
    n = max(1, g.V.count())
    now = written(g.V.select("id", F.lit(1.0 / n).alias("hub"), F.lit(0.0).alias("authority")), "hits")
    scale = F.sum if normalized else F.max

    def unit(df: DataFrame, c: str) -> DataFrame:
        total = df.agg(scale(c)).first()[0] or 1.0
        return df.withColumn(c, F.col(c) / F.lit(total))

    for _ in range(max_iterations):
        a = e.join(now.select("id", "hub"), e["src"] == now["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        a = written(unit(written(a, "authority"), "a"), "authority")
        h = e.join(a, e["dst"] == a["id"]).groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        h = unit(written(h, "hub"), "h")
        nxt = now.select("id", F.col("hub").alias("was")).join(h, "id", "left").join(a, "id", "left")
        nxt = written(nxt.select("id", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"), "was"), "hits")
        moved = nxt.agg(F.sum(F.abs(F.col("hub") - F.col("was")))).first()[0] or 0.0
        now = nxt.drop("was")
        if moved < tolerance:
            break
    return now.select(F.col("id").alias("node"), F.col("hub").alias("hubs"), F.col("authority").alias("authorities"))


@register("degree_centrality.get")
def degree_centrality(g: PropertyGraph, type: str | None = None) -> DataFrame:  # noqa: A002
    """(node, degree): degree over n - 1; undirected (in and out, the default), out or in."""
    kind = (type or "undirected").lower()
    ends = {"undirected": ["src", "dst"], "out": ["src"], "in": ["dst"]}
    if kind not in ends:
        raise ValueError("type is undirected, out or in")
    n = g.V.count()
    counts = None
    for end in ends[kind]:
        own = g.E.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("d"))
        counts = own if counts is None else counts.union(own).groupBy("id").agg(F.sum("d").alias("d"))
    share = F.coalesce("d", F.lit(0)) / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)
    return g.V.select("id").join(counts, "id", "left").select(F.col("id").alias("node"), share.cast("double").alias("degree"))


@register("degree_centrality.get_subgraph")
def degree_centrality_subgraph(g: PropertyGraph, subgraph_nodes, subgraph_relationships, type: str | None = None) -> DataFrame:  # noqa: A002
    return degree_centrality(g.subgraph(subgraph_nodes, subgraph_relationships), type)


def adjacency(e: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Edges (src, dst, perhaps w) as sorted ids, offsets, targets and weights, for kernels that need the graph whole on every task."""
    weighted = "w" in e.columns
    t = e.select("src", "dst", *["w"] * weighted).toArrow()
    src, dst = t.column("src").to_numpy(), t.column("dst").to_numpy()
    ids = np.unique(np.concatenate([src, dst]))
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.lexsort((d, s))
    return ids, np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(ids)))]), d[order], t.column("w").to_numpy()[order] if weighted else None


#: A copy of the adjacency goes to every task; so many edges take 80 MB there.
ADJACENCY_EDGES = 10_000_000


def brandes(source: int, offs: np.ndarray, to: np.ndarray, score: np.ndarray, endpoints: bool = False, mass: np.ndarray | None = None) -> None:
    """Add the dependencies of one source to score, level by level; parallel edges are parallel paths, and a vertex may stand for a mass of them."""
    n = len(offs) - 1
    depth, paths = np.full(n, -1), np.zeros(n)
    depth[source], paths[source] = 0, 1.0
    front, layers = np.array([source]), []
    while len(front):
        size = offs[front + 1] - offs[front]
        a = np.repeat(front, size)
        b = to[np.repeat(offs[front], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        new = np.unique(b[depth[b] < 0])
        depth[new] = depth[front[0]] + 1
        on = depth[b] == depth[front[0]] + 1
        a, b = a[on], b[on]
        np.add.at(paths, b, paths[a])
        layers.append((a, b))
        front = new
    delta = np.zeros(n)
    for a, b in reversed(layers):
        np.add.at(delta, a, paths[a] / paths[b] * ((1 if mass is None else mass[b]) + delta[b]))
    delta[source] = 0
    score += delta if mass is None else mass[source] * delta
    if endpoints:
        reached = depth > 0
        score[reached] += 1
        score[source] += reached.sum()


def brandes_weighted(source: int, offs: np.ndarray, to: np.ndarray, cost: np.ndarray, score: np.ndarray, endpoints: bool = False) -> None:
    """As brandes(), by lengths of paths; every cost is positive, so that a vertex is settled before those behind it."""
    dist, paths, before, order = {source: 0.0}, {source: 1.0}, {source: []}, []
    todo, settled = [(0.0, source)], set()
    while todo:
        far, x = heapq.heappop(todo)
        if x in settled:
            continue
        settled.add(x)
        order.append(x)
        for y, c in zip(to[offs[x] : offs[x + 1]].tolist(), cost[offs[x] : offs[x + 1]].tolist(), strict=True):
            way, known = far + c, dist.get(y, np.inf)
            if way < known:
                dist[y], paths[y], before[y] = way, paths[x], [x]
                heapq.heappush(todo, (way, y))
            elif way == known and y not in settled:
                paths[y] += paths[x]
                before[y].append(x)
    delta = dict.fromkeys(order, 0.0)
    for y in reversed(order[1:]):
        for x in before[y]:
            delta[x] += paths[x] / paths[y] * (1 + delta[y])
        score[y] += delta[y] + endpoints
    score[source] += (len(order) - 1) * endpoints


def betweenness_sums(g: PropertyGraph, edges: DataFrame, sources: DataFrame | None = None, endpoints: bool = False, masses: DataFrame | None = None) -> DataFrame:
    """(node, score): dependencies summed over all sources, which are spread over the tasks; edges may have a cost w, or vertices masses (id, w)."""
    size = edges.count()
    if size > ADJACENCY_EDGES:
        raise ValueError(f"{size} edges exceed the {ADJACENCY_EDGES} that a task holds; take a subgraph")
    spark = g.spark
    ids, offs, to, cost = adjacency(edges)
    mass = None
    if masses is not None:
        t = masses.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", "w").toArrow()
        mass = t.column("w").to_numpy().astype(float)[np.argsort(t.column("id").to_numpy())]
    shared = spark.sparkContext.broadcast((ids, offs, to, cost, mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offs, to, cost, mass = shared.value
        score = np.zeros(len(ids))
        for batch in batches:
            for s in batch.column("id").to_pylist():
                i = int(np.searchsorted(ids, s))
                if i < len(ids) and ids[i] == s and cost is None:
                    brandes(i, offs, to, score, endpoints, mass)
                elif i < len(ids) and ids[i] == s:
                    brandes_weighted(i, offs, to, cost, score, endpoints)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(score)], names=["id", "score"])

    start = (g.V.select("id") if sources is None else sources).repartition(max(1, spark.sparkContext.defaultParallelism), "id")
    part = start.mapInArrow(run, "id long, score double").groupBy("id").agg(F.sum("score").alias("score"))
    return g.V.select("id").join(part, "id", "left").select(F.col("id").alias("node"), F.coalesce("score", F.lit(0.0)).alias("score"))


#: Up to so many links all sources are searched from without a look for trees first.
FEW_SEARCHED = 2000


def undirected_sums(g: PropertyGraph, few: int = FEW_SEARCHED) -> DataFrame:
    """(node, score): betweenness over unordered pairs, directions ignored.

    Trees that hang on the graph are taken off by rounds.  What a vertex of them
    lies between follows from how many hang on each of its branches and how many
    its component holds; only what is left is searched, each vertex with the
    mass that hangs on it.
    """
    both = g.undirected().select("src", "dst")
    if g.E.count() <= few:
        return betweenness_sums(g, both).select("node", (F.col("score") / 2).alias("score"))
    rounds, left = peel(g.E, 0)
    # (id, w: how many hang on it, squares: the sum of the squares by branch); long sums are exact.
    hung, trees = g.spark.createDataFrame([], "id long, w long, squares long"), []
    for off in rounds:
        own = off.join(hung.hint("shuffle_hash"), off["leaf"] == hung["id"], "left")
        own = written(own.select("leaf", "parent", (F.coalesce("w", F.lit(0)) + 1).alias("w"), F.coalesce("squares", F.lit(0)).alias("squares")), "trees")
        trees.append(own)
        more = own.groupBy(F.col("parent").alias("id")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("squares"))
        hung = written(hung.union(more).groupBy("id").agg(F.sum("w").alias("w"), F.sum("squares").alias("squares")), "hung")
    gone = None
    for own in trees:
        gone = own.select(F.col("leaf").alias("id")) if gone is None else gone.union(own.select("leaf"))
    roots = g.V.select("id").distinct()
    roots = roots if gone is None else roots.join(gone.hint("shuffle_hash"), "id", "left_anti")
    roots = written(roots.join(hung.hint("shuffle_hash"), "id", "left").select("id", (F.coalesce("w", F.lit(0)) + 1).alias("w"), F.coalesce("squares", F.lit(0)).alias("squares")), "roots")
    link = left.select(F.col("a").alias("src"), F.col("b").alias("dst"), "m")
    if link.isEmpty():
        roots = roots.withColumn("size", F.col("w")).withColumn("inner", F.lit(0.0))
    else:
        parts = components(roots, link)
        sizes = parts.join(roots.select("id", "w").hint("shuffle_hash"), "id").groupBy("component").agg(F.sum("w").alias("size"))
        core = between(g.E, left).select("src", "dst")
        core = written(core.union(core.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "core")
        inner = betweenness_sums(PropertyGraph(core.select(F.col("src").alias("id")).distinct(), link), core, masses=roots)
        inner = inner.select(F.col("node").alias("id"), (F.col("score") / 2).alias("inner"))
        roots = roots.join(parts.join(sizes, "component").select("id", "size").hint("shuffle_hash"), "id").join(inner.hint("shuffle_hash"), "id", "left").fillna(0.0, ["inner"])
        roots = written(roots, "roots")
    hanging = (F.col("w") - 1) * (F.col("w") - 1) - F.col("squares")
    out = roots.select("id", (hanging / 2 + (F.col("w") - 1) * (F.col("size") - F.col("w")) + F.col("inner")).alias("score"))
    known = roots.select("id", "size")
    for own in reversed(trees):
        # Sizes come down from the parents, which went in later rounds or stay.
        own = written(own.join(known.withColumnRenamed("id", "parent").hint("shuffle_hash"), "parent").select(F.col("leaf").alias("id"), "w", "squares", "size"), "sized")
        rest = F.col("size") - F.col("w")
        out = out.union(own.select("id", (((F.col("size") - 1) * (F.col("size") - 1) - F.col("squares") - rest * rest) / 2).alias("score")))
        known = written(known.union(own.select("id", "size")), "known")
    return out.select(F.col("id").alias("node"), "score")


@register("betweenness_centrality.get")
def betweenness(g: PropertyGraph, directed: bool = True, normalized: bool = True, threads: int | None = None) -> DataFrame:
    """(node, betweenness_centrality) by unweighted shortest paths."""
    n = g.V.count()
    scale = 1.0
    if normalized and n > 2:
        scale *= (1.0 if directed else 2.0) / ((n - 1) * (n - 2))
    sums = betweenness_sums(g, g.E.select("src", "dst")) if directed else undirected_sums(g)
    return sums.select("node", (F.col("score") * scale).alias("betweenness_centrality"))


@register("cugraph.betweenness_centrality.get")
def betweenness_gpu(g: PropertyGraph, normalized: bool = True, directed: bool = True, k: int = 0, seed: int = 42) -> DataFrame:
    """As betweenness_centrality.get; k > 0 takes k sources and scales up."""
    if k <= 0:
        return betweenness(g, directed, normalized)
    return nx_betweenness(g if directed else PropertyGraph(g.V, g.undirected()), k, normalized, seed=seed).withColumnRenamed("betweenness", "betweenness_centrality")


@register("nxalg.betweenness_centrality")
def nx_betweenness(g: PropertyGraph, k: int | None = None, normalized: bool = True, weight: str | None = None, endpoints: bool = False, seed: int | None = None) -> DataFrame:
    """(node, betweenness) on the simple directed view; by a weight, of parallel edges the lightest counts and each is positive."""
    e, n = g.E.select("src", "dst", g.weight(weight).alias("w")).filter("src <> dst"), g.V.count()
    if weight is None:
        e = e.select("src", "dst").distinct()
    else:
        e = written(e.groupBy("src", "dst").agg(F.min("w").alias("w")), "costs")
        if not e.filter("not w > 0 or isnan(w)").isEmpty():
            raise ValueError(f"shortest paths need a positive {weight} on every edge")
    sources = g.V.select("id").orderBy(F.xxhash64("id", F.lit(seed or 0)), "id").limit(k) if k else None
    scale = 1.0 if not normalized or n <= 2 else 1.0 / ((n - 1) * (n if endpoints else n - 2))
    scale *= n / k if k else 1.0
    return betweenness_sums(g, e, sources, endpoints).select("node", (F.col("score") * scale).alias("betweenness"))


def bfs_depths(adj: dict[int, list[int]], source: int) -> dict[int, int]:
    depth, todo = {source: 0}, deque([source])
    while todo:
        x = todo.popleft()
        for y in adj.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    return depth
