"""The rest of the NetworkX facade: searches, distances, trees, tests and small-graph measures."""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..kernels import exact
from ..plans.lineage import written
from ..plans.loops import apply_per_component, components, levels, relax
from ..registry import register
from .flow import _seed, _weighted, all_lengths
from .paths import PATH, all_simple_paths
from .structure import _hanging, strong_labels

#: Kernels that need a whole graph on one machine refuse more edges than this.
WHOLE_EDGES = 2_000_000


def whole(g: PropertyGraph) -> tuple[list[int], exact.Edges]:
    """Nodes and edges on the driver, size-checked, for measures that have no distributed form."""
    n = g.E.count()
    if n > WHOLE_EDGES:
        raise ValueError(f"{n} edges exceed the {WHOLE_EDGES} that this measure takes; use a subgraph")
    v = g.V.select("id").toArrow().column("id").to_pylist()
    e = g.E.select("id", "src", "dst", g.weight().alias("w")).toArrow()
    return sorted(v), sorted(zip(*(e.column(c).to_pylist() for c in ("id", "src", "dst", "w")), strict=True), key=lambda x: (x[1], x[2], x[0]))


def sets_of(g: PropertyGraph) -> dict[int, set[int]]:
    return exact._sets(*whole(g))


def one(g: PropertyGraph, value, schema: str) -> DataFrame:
    return g.spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema)


def _degree(g: PropertyGraph, kind: str, weight: str | None) -> DataFrame:
    w = g.weight(weight) if weight else F.lit(1.0)
    return g.E.groupBy(F.col("src" if kind == "out" else "dst").alias("id")).agg(F.sum(w).alias("d"))


@register("nxalg.degree_assortativity_coefficient")
def degree_assortativity(g: PropertyGraph, x: str = "out", y: str = "in", weight: str | None = None, nodes=None) -> DataFrame:
    """(assortativity): Pearson correlation of the ends' degrees over edges."""
    e = g.E if nodes is None else g.E.join(g._ids(nodes).withColumnRenamed("id", "src"), "src", "left_semi")
    a, b = _degree(g, x, weight), _degree(g, y, weight)
    both = e.select("src", "dst").join(a.select(F.col("id").alias("src"), F.col("d").alias("dx")), "src", "left").join(b.select(F.col("id").alias("dst"), F.col("d").alias("dy")), "dst", "left").fillna(0.0)
    return both.agg(F.corr("dx", "dy").alias("assortativity"))


@register("nxalg.is_at_free")
def is_at_free(g: PropertyGraph) -> DataFrame:
    return one(g, not exact.has_asteroidal_triple(sets_of(g)), "is_at_free boolean")


@register("nxalg.is_chordal")
def is_chordal(g: PropertyGraph) -> DataFrame:
    found = apply_per_component(g.V, g.E, lambda n, e: [(exact.is_chordal(exact._sets(n, e)),)], "ok boolean")
    return found.agg(F.coalesce(F.min("ok"), F.lit(True)).alias("is_chordal"))


@register("nxalg.check_planarity")
def check_planarity(g: PropertyGraph) -> DataFrame:
    _, v, e = _hanging(g)  # what hangs on by one neighbour can be drawn beside it
    found = apply_per_component(v, e, lambda n, e: [(exact.is_planar(exact._sets(n, e)),)], "ok boolean")
    return found.agg(F.coalesce(F.min("ok"), F.lit(True)).alias("is_planar"))


@register("nxalg.node_boundary")
def node_boundary(g: PropertyGraph, nbunch1, nbunch2=None) -> DataFrame:
    """(boundary): out-neighbours of the first set that aren't in it (and are in the second)."""
    s = g._ids(nbunch1)
    out = g.E.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(s, "id", "left_anti")
    return (out if nbunch2 is None else out.join(g._ids(nbunch2), "id", "left_semi")).select(F.col("id").alias("boundary"))


@register("nxalg.node_expansion")
def node_expansion(g: PropertyGraph, s) -> DataFrame:
    ids = g._ids(s)
    found = node_boundary(g, s).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("size"))))
    return found.select((F.col("n") / F.col("size")).alias("node_expansion"))


@register("nxalg.clustering")
def clustering(g: PropertyGraph, nodes=None, weight: str | None = None) -> DataFrame:
    """(node, clustering) of the directed view: triangles through a node over the triangles there could be."""
    e = written(g.E.select("src", "dst").filter("src <> dst").distinct(), "links")
    both = written(e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")), "both")
    # m counts directions between two nodes, so products of three m's count directed triangles.
    a, b = both.select(F.col("src").alias("v"), F.col("dst").alias("x"), F.col("m").alias("m1")), both.select(F.col("src").alias("v"), F.col("dst").alias("y"), F.col("m").alias("m2"))
    c = both.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("m").alias("m3"))
    tri = a.join(c, "x").join(b, ["v", "y"]).groupBy("v").agg(F.sum(F.col("m1") * F.col("m2") * F.col("m3")).alias("t"))
    deg = both.groupBy(F.col("src").alias("v")).agg(F.sum("m").alias("d"), F.sum(F.when(F.col("m") == 2, 1).otherwise(0)).alias("r"))
    room = 2 * (F.col("d") * (F.col("d") - 1) - 2 * F.col("r"))
    out = g.V.select(F.col("id").alias("v")).join(deg, "v", "left").join(tri, "v", "left")
    out = out.select(F.col("v").alias("node"), F.when(F.coalesce(room, F.lit(0)) == 0, 0.0).otherwise(F.coalesce("t", F.lit(0)) / room).alias("clustering"))
    return out if nodes is None else out.join(g._ids(nodes).withColumnRenamed("id", "node"), "node", "left_semi")


@register("nxalg.communicability")
def communicability(g: PropertyGraph) -> DataFrame:
    """(node1, node2, communicability): entries of the exponential of the adjacency matrix."""
    nodes, edges = whole(g)
    if len(nodes) > 2000:
        raise ValueError("communicability takes up to 2000 nodes")
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for _, x, y, _ in edges:
        a[at[x], at[y]] = a[at[y], at[x]] = 1.0
    w, v = np.linalg.eigh(a)
    m = (v * np.exp(w)) @ v.T
    return g.spark.createDataFrame([(nodes[i], nodes[j], float(m[i, j])) for i in range(len(nodes)) for j in range(len(nodes))], "node1 long, node2 long, communicability double")


@register("nxalg.is_edge_cover")
def is_edge_cover(g: PropertyGraph, cover) -> DataFrame:
    """(is_edge_cover): whether edges (ids) touch every node."""
    e = g.E.join(g._ids(cover), "id", "left_semi")
    left = g.V.select("id").join(e.select(F.col("src").alias("id")).union(e.select("dst")), "id", "left_anti")
    return one(g, left.isEmpty(), "is_edge_cover boolean")


def _eccentricities(g: PropertyGraph) -> DataFrame:
    n = g.V.count()
    reach = all_lengths(g).groupBy(F.col("source").alias("id")).agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    reach = written(reach, "reach")
    if not reach.filter(F.col("n") < n).isEmpty():
        raise ValueError("the graph isn't strongly connected")
    return reach


@register("nxalg.center")
def center(g: PropertyGraph) -> DataFrame:
    far = _eccentricities(g)
    least = far.agg(F.min("far").alias("least"))
    return far.join(F.broadcast(least), F.col("far") == F.col("least")).select(F.col("id").alias("center"))


@register("nxalg.diameter")
def diameter(g: PropertyGraph) -> DataFrame:
    return _eccentricities(g).agg(F.max("far").cast("long").alias("diameter"))


@register("nxalg.is_distance_regular")
def is_distance_regular(g: PropertyGraph) -> DataFrame:
    """(is_distance_regular): how many neighbours lie nearer and farther depends on the distance of two nodes alone."""
    adj = sets_of(g)
    from .centrality import bfs_depths

    seen: dict[int, tuple[int, int]] = {}
    ok = bool(adj) and len({len(x) for x in adj.values()}) == 1
    for u in sorted(adj) if ok else []:
        d = bfs_depths(adj, u)
        if len(d) < len(adj):
            ok = False
        for v in d if ok else []:
            pair = (sum(d[x] == d[v] - 1 for x in adj[v]), sum(d[x] == d[v] + 1 for x in adj[v]))
            ok = ok and seen.setdefault(d[v], pair) == pair
        if not ok:
            break
    return one(g, ok, "is_distance_regular boolean")


@register("nxalg.is_strongly_regular")
def is_strongly_regular(g: PropertyGraph) -> DataFrame:
    adj = sets_of(g)
    nodes = sorted(adj)
    common = {True: set(), False: set()}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            common[b in adj[a]].add(len(adj[a] & adj[b]))
    # Distance-regular of diameter 2: neither without edges nor complete, and every two nodes apart share a neighbour.
    return one(g, bool(adj) and len({len(x) for x in adj.values()}) == 1 and all(len(x) == 1 for x in common.values()) and common[False] != {0}, "is_strongly_regular boolean")


@register("nxalg.immediate_dominators")
def immediate_dominators(g: PropertyGraph, start: int) -> DataFrame:
    nodes, edges = whole(g)
    return g.spark.createDataFrame(sorted(exact.dominators(start, exact.directed(nodes, edges)).items()), "node long, dominator long")


@register("nxalg.dominance_frontiers")
def dominance_frontiers(g: PropertyGraph, start: int) -> DataFrame:
    nodes, edges = whole(g)
    return g.spark.createDataFrame(sorted(exact.dominance_frontiers(start, exact.directed(nodes, edges)).items()), "node long, frontier array<long>")


@register("nxalg.dominating_set")
def dominating_set(g: PropertyGraph, start: int) -> DataFrame:
    """(dominating_set): start, then the least node that nothing chosen points to, and so on."""
    nodes, edges = whole(g)
    adj, out, left = exact.directed(nodes, edges), [start], set(nodes) - {start}
    left -= set(adj[start])
    while left:
        out.append(min(left))
        left -= {out[-1], *adj[out[-1]]}
    return g.spark.createDataFrame([(n,) for n in out], "dominating_set long")


def _efficiency(nodes: set[int], adj: dict[int, set[int]]) -> float:
    from .centrality import bfs_depths

    if len(nodes) < 2:
        return 0.0
    own = {n: adj[n] & nodes for n in nodes}
    return sum(1 / d for n in nodes for d in bfs_depths(own, n).values() if d) / (len(nodes) * (len(nodes) - 1))


@register("nxalg.local_efficiency")
def local_efficiency(g: PropertyGraph) -> DataFrame:
    """(local_efficiency): mean efficiency of the graphs of each node's neighbours."""
    found = apply_per_component(g.V, g.E, lambda n, e: [(x, _efficiency(a, s)) for s in [exact._sets(n, e)] for x, a in s.items()], "id long, x double")
    return found.agg(F.avg("x").alias("local_efficiency"))


@register("nxalg.global_efficiency")
def global_efficiency(g: PropertyGraph) -> DataFrame:
    n = g.V.count()
    found = all_lengths(g, None, directed=False).filter("distance > 0").agg(F.coalesce(F.sum(1 / F.col("distance")), F.lit(0.0)).alias("s"))
    return found.select((F.col("s") / float(n * (n - 1)) if n > 1 else F.lit(0.0)).alias("global_efficiency"))


def _balance(g: PropertyGraph) -> tuple[int, int, int, bool]:
    """(nodes with one more out, one more in, otherwise unbalanced; whether nodes with edges are one component)."""
    ends = g.E.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(g.E.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("id").agg((F.sum("o") - F.sum("i")).alias("d"))
    row = d.agg(F.sum((F.col("d") == 1).cast("int")).alias("a"), F.sum((F.col("d") == -1).cast("int")).alias("b"), F.sum((F.abs("d") > 1).cast("int")).alias("c")).first()
    joined = components(d.select("id"), g.E).select("component").distinct().limit(2).count() <= 1
    return row["a"] or 0, row["b"] or 0, row["c"] or 0, joined


def _euler(g: PropertyGraph) -> tuple[bool, bool]:
    a, b, c, joined = _balance(g)
    alone = g.V.join(g.E.select(F.col("src").alias("id")).union(g.E.select("dst")), "id", "left_anti").isEmpty()
    some = a or b or c or not g.E.isEmpty()
    # Without edges only a single node has a path, and it is a circuit.
    lone = not some and g.V.limit(2).count() == 1
    return lone or (some and joined and alone and a == b == c == 0), lone or (some and joined and c == 0 and (a, b) in ((0, 0), (1, 1)))


@register("nxalg.is_eulerian")
def is_eulerian(g: PropertyGraph) -> DataFrame:
    return one(g, _euler(g)[0], "is_eulerian boolean")


@register("nxalg.has_eulerian_path")
def has_eulerian_path(g: PropertyGraph) -> DataFrame:
    return one(g, _euler(g)[1], "has_eulerian_path boolean")


@register("nxalg.is_semieulerian")
def is_semieulerian(g: PropertyGraph) -> DataFrame:
    circuit, path = _euler(g)
    return one(g, path and not circuit, "is_semieulerian boolean")


@register("nxalg.flow_hierarchy")
def flow_hierarchy(g: PropertyGraph, weight: str | None = None) -> DataFrame:
    """(flow_hierarchy): the share of edges (or weight) that lie on no cycle."""
    label = strong_labels(g)
    e = g.E.select("src", "dst", (g.weight(weight) if weight else F.lit(1.0)).alias("w"))
    on = e.join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("src <> dst and a = b")
    on = on.select("w").union(e.filter("src = dst").select("w")).agg(F.sum("w").alias("on"))
    every = e.agg(F.sum("w").alias("w"))
    return every.crossJoin(F.broadcast(on)).select((1 - F.coalesce("on", F.lit(0.0)) / F.col("w")).alias("flow_hierarchy"))  # one row each


@register("nxalg.isolates")
def isolates(g: PropertyGraph) -> DataFrame:
    ends = g.E.select(F.explode(F.array("src", "dst")).alias("id")).distinct()  # edges are read once, and ends dealt out once each
    return g.V.select("id").join(ends, "id", "left_anti").select(F.col("id").alias("isolates"))


@register("nxalg.is_isolate")
def is_isolate(g: PropertyGraph, n: int) -> DataFrame:
    return isolates(g).agg(F.coalesce(F.max(F.col("isolates") == n), F.lit(False)).alias("is_isolate"))


@register("nxalg.is_isomorphic")
def is_isomorphic(g: PropertyGraph, nodes1, edges1, nodes2, edges2) -> DataFrame:
    def counted(nodes, edges) -> dict[int, Counter]:
        n, e = whole(g.subgraph(nodes, edges))
        out = {x: Counter() for x in n}
        for _, a, b, _ in e:
            out[a][b] += 1
        return out

    return one(g, exact.isomorphic(counted(nodes1, edges1), counted(nodes2, edges2)), "is_isomorphic boolean")


@register("nxalg.lowest_common_ancestor")
def lowest_common_ancestor(g: PropertyGraph, node1: int, node2: int) -> DataFrame:
    """(ancestor): a common ancestor below which there is no other; of several the deepest, then the least."""
    back = g.E.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    a, b = (levels(back, g._ids(n)).select("id") for n in (node1, node2))
    common = written(a.join(b, "id", "left_semi"), "common")
    above = g.E.join(common.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return common.join(above, "id", "left_anti").agg(F.min("id").alias("ancestor"))


@register("nxalg.maximal_matching")
def maximal_matching(g: PropertyGraph) -> DataFrame:
    """(edges: [a, b]): rounds in which an edge that outranks all it touches is taken."""
    e = g.E.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("rank", F.struct(F.xxhash64("a", "b").alias("h"), "a", "b"))
    left, chosen = written(e, "left"), None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("n"), "rank").union(left.select("b", "rank")).groupBy("n").agg(F.min("rank").alias("best"))
        ok = left.join(ends.select(F.col("n").alias("a"), F.col("best").alias("x")), "a").join(ends.select(F.col("n").alias("b"), F.col("best").alias("y")), "b")
        taken = written(ok.filter("rank = x and rank = y").select("a", "b"), "taken")
        chosen = taken if chosen is None else written(chosen.union(taken), "matching")
        gone = taken.select(F.col("a").alias("n")).union(taken.select("b"))
        left = written(left.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b", "rank"), "left")
    return (chosen if chosen is not None else e.select("a", "b").limit(0)).select(F.array("a", "b").alias("edges"))


@register("nxalg.non_randomness")
def non_randomness(g: PropertyGraph, k: int | None = None) -> DataFrame:
    """(non_randomness, relative_non_randomness): sum of the k largest eigenvalues, and how far it is from a random graph's."""
    nodes, edges = whole(g)
    adj = exact._sets(nodes, edges)
    n, m = len(nodes), sum(map(len, adj.values())) // 2
    if any(a == b for _, a, b, _ in edges) or not m or len(exact._pieces(adj, set(adj))) > 1:
        raise ValueError("the graph must be connected, with edges and without self-loops")
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((n, n))
    for x, ys in adj.items():
        for y in ys:
            a[at[x], at[y]] = 1.0
    k = k or label_communities(adj)
    p = 2 * k * m / (n * (n - k)) if n > k else float("inf")
    if not 1 <= k < n or not 0 < p < 1:
        raise ValueError("k doesn't fit this graph")
    nr = float(np.sort(np.linalg.eigvalsh(a))[::-1][:k].sum())
    return one(g, (nr, float((nr - ((n - 2 * k) * p + k)) / math.sqrt(2 * k * p * (1 - p)))), "non_randomness double, relative_non_randomness double")


def label_communities(adj: dict[int, set[int]]) -> int:
    """How many communities label propagation finds."""
    label = {x: x for x in adj}
    for _ in range(100):
        moved = False
        for x in sorted(adj):
            if adj[x]:
                votes = Counter(label[y] for y in adj[x])
                best = min(votes, key=lambda c: (-votes[c], c))
                if votes[best] > votes.get(label[x], 0):
                    label[x], moved = best, True
        if not moved:
            break
    return len(set(label.values()))


@register("nxalg.reciprocity")
def reciprocity(g: PropertyGraph, nodes=None) -> DataFrame:
    """(node, reciprocity): overall (node is null), or of each given node."""
    e = written(g.E.select("src", "dst").distinct(), "links")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = e.join(back, ["src", "dst"], "left_semi")
    if nodes is None:
        n = both.agg(F.count(F.lit(1)).alias("b")).crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))
        return n.select(F.lit(None).cast("long").alias("node"), (F.col("b") / F.col("n")).alias("reciprocity"))
    b = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("b"))
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return g._ids(nodes).withColumnRenamed("id", "node").join(n, "node").join(b, "node", "left").select("node", (2 * F.coalesce("b", F.lit(0)) / F.col("n")).alias("reciprocity"))


def _paths(g: PropertyGraph, source: int | None, target: int | None, weight: str | None) -> DataFrame:
    e = _weighted(g, weight, True)
    seeds = _seed(g, source) if source is not None else g.V.select(F.col("id").alias("source"), "id")
    found = relax(e, seeds)
    return found if target is None else found.filter(F.col("id") == target)


@register("nxalg.shortest_path")
def shortest_path(g: PropertyGraph, source: int | None = None, target: int | None = None, weight: str | None = None, method: str = "dijkstra") -> DataFrame:
    return _paths(g, source, target, weight).select("source", F.col("id").alias("target"), "path")


@register("nxalg.shortest_path_length")
def shortest_path_length(g: PropertyGraph, source: int | None = None, target: int | None = None, weight: str | None = None, method: str = "dijkstra") -> DataFrame:
    return _paths(g, source, target, weight).select("source", F.col("id").alias("target"), F.col("distance").alias("length"))


@register("nxalg.all_shortest_paths")
def all_shortest_paths(g: PropertyGraph, source: int, target: int, weight: str | None = None, method: str = "dijkstra") -> DataFrame:
    """(paths): every path of the least length; grown backwards over edges that lie on one."""
    e = _weighted(g, weight, True).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    d = written(relax(e, _seed(g, source)).select("id", "distance"), "distance")
    tight = e.join(d.select(F.col("id").alias("src"), F.col("distance").alias("da")), "src").join(d.select(F.col("id").alias("dst"), F.col("distance").alias("db")), "dst")
    tight = written(tight.filter(F.abs(F.col("da") + F.col("weight") - F.col("db")) < 1e-9).select("src", "dst"), "tight")
    now = written(d.filter(F.col("id") == target).select("id", F.array("id").alias("paths")), "paths")
    out = now.filter(F.col("id") == source)
    while True:
        now = written(now.filter(F.col("id") != source).join(tight, F.col("id") == F.col("dst")).filter(~F.array_contains("paths", F.col("src"))).select(F.col("src").alias("id"), F.concat(F.array("src"), "paths").alias("paths")), "paths")
        if now.isEmpty():
            return out.select("paths")
        out = out.union(now.filter(F.col("id") == source))


@register("nxalg.has_path")
def has_path(g: PropertyGraph, source: int, target: int) -> DataFrame:
    return one(g, not levels(g.E, g._ids(source)).filter(F.col("id") == target).isEmpty(), "has_path boolean")


def _many(g: PropertyGraph, sources, weight: str, cutoff: float | None) -> DataFrame:
    e = _weighted(g, weight, True)
    seeds = g._ids(sources).select(F.col("id").alias("source"), "id")
    found = relax(e, seeds).groupBy("id").agg(F.min(F.struct("distance", "path", "source")).alias("b")).select("id", "b.*")
    return found if cutoff is None else found.filter(F.col("distance") <= cutoff)


@register("nxalg.multi_source_dijkstra_path")
def multi_source_path(g: PropertyGraph, sources, cutoff: float | None = None, weight: str = "weight") -> DataFrame:
    return _many(g, sources, weight, cutoff).select(F.col("id").alias("target"), "path")


@register("nxalg.multi_source_dijkstra_path_length")
def multi_source_length(g: PropertyGraph, sources, cutoff: float | None = None, weight: str = "weight") -> DataFrame:
    return _many(g, sources, weight, cutoff).select(F.col("id").alias("target"), F.col("distance").alias("length"))


@register("nxalg.voronoi_cells")
def voronoi_cells(g: PropertyGraph, center_nodes, weight: str = "weight") -> DataFrame:
    """(center, cell: sorted ids); what no center reaches is the cell of a null one."""
    near = _many(g, center_nodes, weight, None).select("id", "source")
    all_of = g.V.select("id").join(near, "id", "left")
    return all_of.groupBy(F.col("source").alias("center")).agg(F.array_sort(F.collect_list("id")).alias("cell"))


@register("nxalg.is_simple_path")
def is_simple_path(g: PropertyGraph, nodes: list[int]) -> DataFrame:
    if not nodes or len(set(nodes)) < len(nodes):
        return one(g, False, "is_simple_path boolean")
    if len(nodes) == 1:
        return one(g, not g.V.filter(F.col("id") == nodes[0]).isEmpty(), "is_simple_path boolean")
    steps = g.spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "src long, dst long")
    return one(g, steps.join(g.E.select("src", "dst"), ["src", "dst"], "left_anti").isEmpty(), "is_simple_path boolean")


@register("nxalg.all_simple_paths")
def nx_all_simple_paths(g: PropertyGraph, source: int, target: int, cutoff: int | None = None) -> DataFrame:
    found = all_simple_paths(g, source, target, [">"], g.V.count() - 1 if cutoff is None else cutoff)
    return found.select(F.col(f"path.{PATH.split('<')[1].split(':')[0]}").alias("paths"))


@register("nxalg.is_tournament")
def is_tournament(g: PropertyGraph) -> DataFrame:
    """(is_tournament): exactly one direction between every two nodes, and no self-loop."""
    n = g.V.count()
    e = g.E.select("src", "dst").distinct()
    loops = not e.filter("src = dst").isEmpty()
    pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    row = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.max("k").alias("most")).first()
    return one(g, not loops and row["pairs"] == n * (n - 1) // 2 and (row["most"] or 1) == 1, "is_tournament boolean")


def _bfs(g: PropertyGraph, source: int, reverse: bool, depth_limit: int | None) -> DataFrame:
    """(node, predecessor, depth): of possible predecessors the least id of the level before."""
    e = g.E.select("src", "dst") if not reverse else g.E.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    d = written(levels(e, g._ids(source), depth_limit), "depth")
    steps = e.join(d.select(F.col("id").alias("src"), F.col("depth").alias("a")), "src").join(d.select(F.col("id").alias("dst"), F.col("depth").alias("b")), "dst").filter("b = a + 1")
    return steps.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("predecessor"), F.first("b").alias("depth"))


@register("nxalg.bfs_predecessors")
def bfs_predecessors(g: PropertyGraph, source: int, depth_limit: int | None = None) -> DataFrame:
    return _bfs(g, source, False, depth_limit).select("node", "predecessor")


@register("nxalg.bfs_successors")
def bfs_successors(g: PropertyGraph, source: int, depth_limit: int | None = None) -> DataFrame:
    return _bfs(g, source, False, depth_limit).groupBy(F.col("predecessor").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("successors"))


@register("nxalg.bfs_edges")
def bfs_edges(g: PropertyGraph, source: int, reverse: bool = False, depth_limit: int | None = None) -> DataFrame:
    return _bfs(g, source, reverse, depth_limit).select(F.array("predecessor", "node").alias("edges"))


@register("nxalg.bfs_tree")
def bfs_tree(g: PropertyGraph, source: int, reverse: bool = False, depth_limit: int | None = None) -> DataFrame:
    """(tree: sorted ids)."""
    found = _bfs(g, source, reverse, depth_limit).select(F.col("node").alias("id")).union(g._ids(source))
    return found.agg(F.array_sort(F.collect_set("id")).alias("tree"))


def dfs(adj: dict[int, list[int]], source: int, limit: int | None) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Tree edges, preorder and postorder."""
    edges, pre, post, seen, stack = [], [source], [], {source}, [(source, iter(adj[source]), 0)]
    while stack:
        x, rest, depth = stack[-1]
        for y in rest if limit is None or depth < limit else ():
            if y not in seen:
                seen.add(y)
                edges.append((x, y))
                pre.append(y)
                stack.append((y, iter(adj[y]), depth + 1))
                break
        else:
            post.append(x)
            stack.pop()
    return edges, pre, post


def _dfs_of(g: PropertyGraph, source: int, limit: int | None, what, schema: str) -> DataFrame:
    def kernel(nodes, edges):
        if source in nodes:
            yield from what(*dfs(exact.directed(nodes, edges), source, limit))

    return apply_per_component(g.V, g.E, kernel, schema)


@register("nxalg.dfs_tree")
def dfs_tree(g: PropertyGraph, source: int, depth_limit: int | None = None) -> DataFrame:
    return _dfs_of(g, source, depth_limit, lambda e, pre, post: [(sorted(pre),)], "tree array<long>")


@register("nxalg.dfs_predecessors")
def dfs_predecessors(g: PropertyGraph, source: int, depth_limit: int | None = None) -> DataFrame:
    return _dfs_of(g, source, depth_limit, lambda e, pre, post: [(b, a) for a, b in e], "node long, predecessor long")


@register("nxalg.dfs_successors")
def dfs_successors(g: PropertyGraph, source: int, depth_limit: int | None = None) -> DataFrame:
    def lists(e, pre, post):
        out = defaultdict(list)
        for a, b in e:
            out[a].append(b)
        return list(out.items())

    return _dfs_of(g, source, depth_limit, lists, "node long, successors array<long>")


@register("nxalg.dfs_preorder_nodes")
def dfs_preorder(g: PropertyGraph, source: int, depth_limit: int | None = None) -> DataFrame:
    return _dfs_of(g, source, depth_limit, lambda e, pre, post: [(pre,)], "nodes array<long>")


@register("nxalg.dfs_postorder_nodes")
def dfs_postorder(g: PropertyGraph, source: int, depth_limit: int | None = None) -> DataFrame:
    return _dfs_of(g, source, depth_limit, lambda e, pre, post: [(post,)], "nodes array<long>")


def _edge_search(g: PropertyGraph, source: int | None, orientation: str | None, breadth: bool) -> DataFrame:
    if orientation not in (None, "original", "reverse", "ignore"):
        raise ValueError("orientation is original, reverse or ignore")

    def kernel(nodes, edges):
        if source is not None and source not in nodes:
            return
        out = defaultdict(list)
        for i, a, b, _ in edges:
            if orientation != "reverse":
                out[a].append((i, a, b, b))
            if orientation in ("reverse", "ignore"):
                out[b].append((i, a, b, a))
        used, seen, found = set(), set(), []
        for root in [source] if source is not None else nodes:
            todo = deque([root])
            while todo:
                x = todo.popleft() if breadth else todo[-1]
                nxt = [e for e in out[x] if e[0] not in used]
                if breadth:
                    if x in seen:
                        continue
                    seen.add(x)
                    for i, a, b, to in nxt:
                        used.add(i)
                        found.append([a, b])
                        todo.append(to)
                elif nxt:
                    i, a, b, to = nxt[0]
                    used.add(i)
                    found.append([a, b])
                    todo.append(to)
                else:
                    todo.pop()
        yield (found,)

    return apply_per_component(g.V, g.E, kernel, "edges array<array<long>>")


@register("nxalg.edge_bfs")
def edge_bfs(g: PropertyGraph, source: int | None = None, orientation: str | None = None) -> DataFrame:
    """(edges: list of [a, b] in the order they are met), of each component searched."""
    return _edge_search(g, source, orientation, True)


@register("nxalg.edge_dfs")
def edge_dfs(g: PropertyGraph, source: int | None = None, orientation: str | None = None) -> DataFrame:
    return _edge_search(g, source, orientation, False)


def _forest(g: PropertyGraph) -> tuple[bool, bool, bool]:
    """(forest, connected, no node has two incoming edges)."""
    n, m = g.V.count(), g.E.select("src", "dst").distinct().count()
    parts = components(g.V, g.E).agg(F.count_distinct("component")).first()[0]
    most = g.E.select("src", "dst").distinct().groupBy("dst").count().agg(F.max("count")).first()[0] or 0
    return n > 0 and m == n - parts, parts == 1, most <= 1


@register("nxalg.is_tree")
def is_tree(g: PropertyGraph) -> DataFrame:
    forest, joined, _ = _forest(g)
    return one(g, forest and joined, "is_tree boolean")


@register("nxalg.is_forest")
def is_forest(g: PropertyGraph) -> DataFrame:
    return one(g, _forest(g)[0], "is_forest boolean")


@register("nxalg.is_arborescence")
def is_arborescence(g: PropertyGraph) -> DataFrame:
    return one(g, all(_forest(g)), "is_arborescence boolean")


@register("nxalg.is_branching")
def is_branching(g: PropertyGraph) -> DataFrame:
    forest, _, single = _forest(g)
    return one(g, forest and single, "is_branching boolean")


# The sixteen kinds of three nodes, by mutual, asymmetric and null pairs.
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def triad(edges: set[tuple[int, int]]) -> str:
    """The kind of a triad on nodes 0, 1 and 2."""
    pairs = [((a, b) in edges, (b, a) in edges) for a, b in ((0, 1), (0, 2), (1, 2))]
    m, a = sum(p == (True, True) for p in pairs), sum(p[0] != p[1] for p in pairs)
    name = f"{m}{a}{3 - m - a}"
    out, into = Counter(x for x, _ in edges), Counter(y for _, y in edges)
    if name == "021":
        return name + ("D" if 2 in out.values() else "U" if 2 in into.values() else "C")
    if name == "111":
        return name + ("D" if 2 in into.values() else "U")
    if name == "030":
        return name + ("C" if set(out.values()) == {1} else "T")
    if name == "120":
        odd = next(n for n in (0, 1, 2) if all({n, q} != {x, y} or ((x, y) in edges) != ((y, x) in edges) for q in (0, 1, 2) if q != n for x, y in [(n, q)]))
        return name + ("D" if out[odd] == 2 else "U" if into[odd] == 2 else "C")
    return name


@register("nxalg.triadic_census")
def triadic_census(g: PropertyGraph) -> DataFrame:
    """(triad, count) of all sixteen kinds; triads with at most one linked pair are counted from degrees."""
    nodes, edges = whole(g)
    pairs = {(a, b) for _, a, b, _ in edges if a != b}
    adj = exact._sets(nodes, edges)
    n, count = len(nodes), dict.fromkeys(TRIADS, 0)
    for u in nodes:
        for v in adj[u]:
            if u < v:
                near = (adj[u] | adj[v]) - {u, v}
                kind = "102" if (u, v) in pairs and (v, u) in pairs else "012"
                count[kind] += n - len(near) - 2
                for w in near:
                    if v < w or (u < w < v and w not in adj[u]):
                        at = {u: 0, v: 1, w: 2}
                        count[triad({(at[a], at[b]) for a in at for b in at if (a, b) in pairs})] += 1
    count["003"] = n * (n - 1) * (n - 2) // 6 - sum(count.values())
    return g.spark.createDataFrame([(k, int(count[k])) for k in TRIADS], "triad string, count long")


@register("nxalg.wiener_index")
def wiener_index(g: PropertyGraph, weight: str | None = None) -> DataFrame:
    """(wiener_index): the sum of distances of all ordered pairs, infinite if some pair has none."""
    n = g.V.count()
    row = all_lengths(g, weight).agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("s"))
    return row.select(F.when(F.col("n") < n * n, float("inf")).otherwise(F.coalesce("s", F.lit(0.0))).alias("wiener_index"))


