"""Flows and cuts, union-find, set cover, tours and routes, shortest paths and trees of the igraph facade."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, prop
from ..kernels.exact import FlowNet
from ..plans.lineage import written
from ..plans.loops import FEW_LINKS, apply_per_component, components, relax
from ..registry import register
from .paths import all_simple_paths

FOREVER = float("inf")


def _home(g: PropertyGraph, node: int) -> PropertyGraph:
    """The weakly connected component of node."""
    parts = components(g.V, g.E)
    own = written(parts.join(parts.filter(F.col("id") == node).select("component"), "component", "left_semi").select("id"), "home")
    return g.subgraph(own)


def _flow(g: PropertyGraph, s: int, t: int, capacity: str | None, directed: bool, what, schema: str, default: float | None = None) -> DataFrame:
    home = _home(g, s)
    edges = home.E.withColumn("cap", prop(home.E, capacity, "double") if capacity else F.lit(1.0))
    edges = edges.filter("cap is not null") if default is None else edges.fillna(default, ["cap"])

    def kernel(nodes, rows):
        if s not in nodes:
            return
        net, placed = FlowNet(), []
        for i, a, b, w in rows:
            placed.append((i, a, b, w, net.edge(a, b, w, 0.0 if directed else w)))
        value = net.flow(s, t) if t in nodes else 0.0
        yield from what(net, placed, nodes, value)

    # Components are taken before edges without capacity go, so that s keeps its place.
    return apply_per_component(home.V, edges, kernel, schema, extra=[F.col("cap").alias("weight")])


@register("max_flow.get_flow")
def get_flow(g: PropertyGraph, start_v: int, end_v: int, edge_property: str = "weight") -> DataFrame:
    """(max_flow): the true maximum; edges without the property carry nothing."""
    found = _flow(g, start_v, end_v, edge_property, True, lambda net, placed, nodes, value: [(value,)], "max_flow double")
    return found.agg(F.coalesce(F.max("max_flow"), F.lit(0.0)).alias("max_flow"))


@register("max_flow.get_paths")
def get_paths(g: PropertyGraph, start_v: int, end_v: int, edge_property: str = "weight") -> DataFrame:
    """(path, flow): the maximum flow as paths of edge ids."""

    def paths(net, placed, nodes, value):
        used = defaultdict(list)
        left = {}
        for i, a, b, w, e in placed:
            if w - net.room[e] > 1e-12:
                used[a].append((i, b))
                left[i] = w - net.room[e]
        while True:
            x, path, seen = start_v, [], {start_v}
            while x != end_v:
                step = next(((i, b) for i, b in used[x] if left[i] > 1e-12 and b not in seen), None)
                if step is None:
                    break
                path.append(step[0])
                x = step[1]
                seen.add(x)
            if x != end_v or not path:
                return
            amount = min(left[i] for i in path)
            for i in path:
                left[i] -= amount
            yield path, amount

    return _flow(g, start_v, end_v, edge_property, True, paths, "path array<long>, flow double")


@register("igraphalg.maxflow")
def igraph_maxflow(g: PropertyGraph, source: int, target: int, capacity: str = "weight") -> DataFrame:
    return get_flow(g, source, target, capacity)


@register("igraphalg.mincut")
def mincut(g: PropertyGraph, source: int, target: int, capacity: str | None = None, directed: bool = True) -> DataFrame:
    """(node, partition_id): 0 for what source still reaches once the flow is full, else 1."""

    def side(net, placed, nodes, value):
        own = net.side(source)
        for n in nodes:
            yield n, int(n not in own)

    found = _flow(g, source, target, capacity, directed, side, "node long, partition_id long", default=1.0)
    return g.V.select(F.col("id").alias("node")).join(found.filter("partition_id = 0"), "node", "left").fillna(1, ["partition_id"])


@register("union_find.connected")
def connected(g: PropertyGraph, nodes1, nodes2, mode: str = "pairwise", update: bool = True) -> DataFrame:
    """(node1, node2, connected), pair by pair or for every two."""
    if mode.lower() not in ("pairwise", "p", "cartesian", "c"):
        raise ValueError("mode is pairwise or cartesian")
    one, two = ([x] if isinstance(x, int) else list(x) for x in (nodes1, nodes2))
    if mode.lower() in ("pairwise", "p"):
        if len(one) != len(two):
            raise ValueError("the node lists differ in length")
        pairs = list(zip(one, two, strict=True))
    else:
        pairs = [(a, b) for a in one for b in two]  # of the two given lists
    parts = components(g.V, g.E)
    df = g.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, node1 long, node2 long")
    for k in ("1", "2"):
        df = df.join(parts.select(F.col("id").alias(f"node{k}"), F.col("component").alias(f"c{k}")), f"node{k}", "left")
    return df.select("node1", "node2", F.coalesce(F.col("c1") == F.col("c2"), F.lit(False)).alias("connected"))


def _cover_sets(element_vertexes: list[int], set_vertexes: list[int]) -> dict[int, set[int]]:
    if len(element_vertexes) != len(set_vertexes):
        raise ValueError("elements and sets are given pair by pair")
    sets = defaultdict(set)
    for e, s in zip(element_vertexes, set_vertexes, strict=True):
        sets[s].add(e)
    return sets


@register("set_cover.greedy")
def cover_greedy(g: PropertyGraph, element_vertexes: list[int], set_vertexes: list[int]) -> DataFrame:
    """(containing_set): sets that cover all elements, the one of most new elements first."""
    sets, left, out = _cover_sets(element_vertexes, set_vertexes), set(element_vertexes), []
    while left:
        best = max(sorted(sets), key=lambda s: len(sets[s] & left))
        out.append(best)
        left -= sets[best]
    return g.spark.createDataFrame([(s,) for s in out], "containing_set long")


@register("set_cover.cp_solve")
def cover_exact(g: PropertyGraph, element_vertexes: list[int], set_vertexes: list[int]) -> DataFrame:
    """(containing_set): a smallest cover, by branch and bound on the rarest element."""
    sets = _cover_sets(element_vertexes, set_vertexes)
    best: list[int] = [r["containing_set"] for r in cover_greedy(g, element_vertexes, set_vertexes).collect()]
    stack = [(frozenset(element_vertexes), ())]
    while stack:
        left, chosen = stack.pop()
        if not left:
            if len(chosen) < len(best):
                best = list(chosen)
            continue
        largest = max(len(s & left) for s in sets.values())
        if len(chosen) + -(-len(left) // largest) >= len(best):
            continue
        rare = min(sorted(left), key=lambda e: sum(e in s for s in sets.values()))
        for s in sorted((s for s in sets if rare in sets[s]), key=lambda s: len(sets[s] & left)):
            stack.append((left - sets[s], (*chosen, s)))
    return g.spark.createDataFrame([(s,) for s in sorted(best)], "containing_set long")


def _km(a: tuple[float, float], b: tuple[float, float]) -> float:
    p, q, r, s = map(math.radians, (*a, *b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def _coordinates(g: PropertyGraph, points) -> dict[int, tuple[float, float]]:
    v = g.V.join(g._ids(points), "id", "left_semi").select("id", prop(g.V, "lat", "double").alias("lat"), prop(g.V, "lng", "double").alias("lng"))
    rows = v.collect()  # the points that were given
    if any(r["lat"] is None or r["lng"] is None for r in rows):
        raise ValueError("a point has no lat or lng")
    return {r["id"]: (r["lat"], r["lng"]) for r in rows}


def tour(at: dict[int, tuple[float, float]], method: str) -> list[int]:
    """A closed tour over all points, that begins with the least id."""
    nodes = sorted(at)
    if len(nodes) < 3:
        return nodes
    dist = lambda a, b: _km(at[a], at[b])
    if method == "greedy":
        out, left = [nodes[0]], set(nodes[1:])
        while left:
            out.append(min(sorted(left), key=lambda n: dist(out[-1], n)))
            left.discard(out[-1])
        return out
    parent, key, left = {}, dict.fromkeys(nodes, FOREVER), set(nodes)
    key[nodes[0]] = 0.0
    kids: dict[int, list[int]] = defaultdict(list)
    while left:
        x = min(sorted(left), key=key.get)
        left.discard(x)
        if x in parent:
            kids[parent[x]].append(x)
        for y in left:
            if dist(x, y) < key[y]:
                key[y], parent[y] = dist(x, y), x
    if method == "1.5_approx":
        odd = [n for n in nodes if (len(kids[n]) + (n in parent)) % 2]
        multi = defaultdict(list)
        for a in nodes:
            for b in kids[a]:
                multi[a].append(b)
                multi[b].append(a)
        while odd:  # shortest pairs first
            a, b = min(((x, y) for i, x in enumerate(odd) for y in odd[i + 1 :]), key=lambda p: dist(*p))
            odd.remove(a)
            odd.remove(b)
            multi[a].append(b)
            multi[b].append(a)
        walk, stack = [], [nodes[0]]
        while stack:
            if multi[stack[-1]]:
                y = multi[stack[-1]].pop()
                multi[y].remove(stack[-1])
                stack.append(y)
            else:
                walk.append(stack.pop())
        return list(dict.fromkeys(walk[::-1]))
    out, stack = [], [nodes[0]]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += reversed(kids[x])
    return out


@register("tsp.solve")
def tsp(g: PropertyGraph, points: list[int], method: str = "1.5_approx") -> DataFrame:
    """(sources, destinations): the steps of a closed tour by method: greedy, 2_approx or 1.5_approx."""
    if method not in ("greedy", "2_approx", "1.5_approx"):
        raise ValueError("method is greedy, 2_approx or 1.5_approx")
    order = tour(_coordinates(g, points), method)
    steps = list(zip(order, order[1:] + order[:1], strict=True)) if len(order) > 1 else []
    return g.spark.createDataFrame(steps, "sources long, destinations long")


@register("vrp.route")
def vrp(g: PropertyGraph, depot_node: int, number_of_vehicles: int = 1) -> DataFrame:
    """(from_vertex, to_vertex): each vehicle's round from the depot; locations are shared out by bearing, then toured."""
    if number_of_vehicles < 1:
        raise ValueError("there must be a vehicle")
    every = [r["id"] for r in g.V.filter(F.array_contains("labels", "Location") | (F.col("id") == depot_node)).select("id").collect()]
    at = _coordinates(g, every or [depot_node])
    home = at[depot_node]
    rest = sorted((n for n in at if n != depot_node), key=lambda n: (math.atan2(at[n][0] - home[0], at[n][1] - home[1]), n))
    out, k = [], max(1, -(-len(rest) // number_of_vehicles))
    for i in range(0, len(rest), k):
        own = tour({n: at[n] for n in [depot_node, *rest[i : i + k]]}, "2_approx")
        own = own[own.index(depot_node) :] + own[: own.index(depot_node)]
        out += list(zip(own, own[1:] + own[:1], strict=True))
    return g.spark.createDataFrame(out, "from_vertex long, to_vertex long")


def _weighted(g: PropertyGraph, weights: str | None, directed: bool) -> DataFrame:
    e = g.E.select("src", "dst", (g.weight(weights) if weights else F.lit(1.0)).alias("weight"))
    return e if directed else e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _seed(g: PropertyGraph, node: int) -> DataFrame:
    return g.spark.createDataFrame([(node, node)], "source long, id long")


@register("igraphalg.shortest_path_length")
def igraph_length(g: PropertyGraph, source: int, target: int, weights: str | None = None, directed: bool = True) -> DataFrame:
    found = relax(_weighted(g, weights, directed), _seed(g, source)).filter(F.col("id") == target)
    return found.agg(F.coalesce(F.min("distance"), F.lit(FOREVER)).alias("length"))


@register("igraphalg.all_shortest_path_lengths")
def igraph_all_lengths(g: PropertyGraph, weights: str | None = None, directed: bool = False) -> DataFrame:
    """(src_node, dest_node, length) of all ordered pairs, infinite where there is no path."""
    found = all_lengths(g, weights, directed)
    pairs = g.V.select(F.col("id").alias("source")).join(g.V.select("id"))
    return pairs.join(found, ["source", "id"], "left").select(F.col("source").alias("src_node"), F.col("id").alias("dest_node"), F.coalesce("distance", F.lit(FOREVER)).alias("length"))


def all_lengths(g: PropertyGraph, weights: str | None = None, directed: bool = True) -> DataFrame:
    """(source, id, distance) of all reachable ordered pairs, itself included."""
    return relax(_weighted(g, weights, directed), g.V.select(F.col("id").alias("source"), "id")).select("source", "id", "distance")


@register("igraphalg.get_shortest_path")
def igraph_path(g: PropertyGraph, source: int, target: int, weights: str | None = None, directed: bool = True) -> DataFrame:
    return relax(_weighted(g, weights, directed), _seed(g, source)).filter(F.col("id") == target).select("path")


@register("igraphalg.get_all_simple_paths")
def igraph_simple_paths(g: PropertyGraph, v: int, to: int, cutoff: int = -1) -> DataFrame:
    n = g.V.count() - 1 if cutoff < 0 else cutoff
    return all_simple_paths(g, v, to, [">"], n).select(F.col("path.nodes").alias("path")).distinct()


def spanning_edges(g: PropertyGraph, weights: str | None) -> DataFrame:
    """(id, src, dst, weight) of a least spanning forest, by Boruvka's rounds; ties go to the lesser edge id."""
    e = written(g.E.filter("src <> dst").select("id", "src", "dst", (g.weight(weights) if weights else F.lit(1.0)).alias("weight")), "edges")
    label = written(g.V.select("id", F.col("id").alias("c")), "trees")
    # Files of labels are small for what they hold, so that the larger are kept from being broadcast.
    large = e.count() > FEW_LINKS
    chosen = e.limit(0)
    while True:
        label = label.hint("merge") if large else label
        out = e.join(label.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a <> b")
        out = written(out, "crossing")
        if out.isEmpty():
            return chosen
        ends = out.select(F.col("a").alias("c"), "id", "src", "dst", "weight").union(out.select("b", "id", "src", "dst", "weight"))
        best = ends.groupBy("c").agg(F.min(F.struct("weight", "id", "src", "dst")).alias("e")).select("e.id", "e.src", "e.dst", "e.weight").distinct()
        chosen = written(chosen.union(best.select(chosen.columns)).distinct(), "tree")
        label = written(components(g.V, chosen).select("id", F.col("component").alias("c")), "trees")


@register("igraphalg.spanning_tree")
def igraph_spanning_tree(g: PropertyGraph, weights: str | None = None, directed: bool = False) -> DataFrame:
    """(tree: [a, b]) of each edge."""
    return spanning_edges(g, weights).select(F.array("src", "dst").alias("tree"))


@register("nxalg.minimum_spanning_tree")
def nx_spanning_tree(g: PropertyGraph, weight: str = "weight", algorithm: str = "kruskal", ignore_nan: bool = False) -> DataFrame:
    """(nodes, edges): sorted lists."""
    e = spanning_edges(g, weight).agg(F.array_sort(F.collect_list("id")).alias("edges"))
    return g.V.agg(F.array_sort(F.collect_list("id")).alias("nodes")).crossJoin(F.broadcast(e))  # one row each
