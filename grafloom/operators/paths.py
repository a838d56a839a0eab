"""Paths, traversals and neighbourhoods.

A path is a struct of nodes (ids) and rels (edge ids), one more node than rels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.collections import _guard
from ..functions.text import haversine
from ..graph import PropertyGraph, prop
from ..plans.filters import label_rules, steps
from ..plans.lineage import written
from ..plans.loops import levels, relax
from ..registry import function, register

PATH = "struct<nodes:array<bigint>,rels:array<bigint>>"


def _empty(g: PropertyGraph, name: str = "result") -> DataFrame:
    return g.spark.createDataFrame([], f"{name} {PATH}")


def _marked(g: PropertyGraph, labels: list[str] | None) -> DataFrame:
    rules = label_rules(F.col("labels"), labels)
    return g.V.select("id", rules.valid.alias("valid"), rules.expand.alias("expand"))


@register("path.expand")
def expand(g: PropertyGraph, start, relationships: list[str], labels: list[str], min_hops: int, max_hops: int) -> DataFrame:
    """(result): paths from start that use no edge twice, of min_hops to max_hops edges.

    One join a hop; a hop's table holds only paths that may go on.
    """
    link = written(steps(g, relationships), "steps")
    marks = written(_marked(g, labels), "marks")
    now = g.V.join(g._ids(start), "id", "left_semi").select("id", F.array("id").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("rels"))
    out = []
    for hop in range(max_hops + 1):
        now = written(now.join(marks, "id"), "paths")
        if hop >= min_hops:
            out.append(now.filter("valid").select("nodes", "rels"))
        now = now.filter("expand")
        if hop == max_hops or now.isEmpty():
            break
        grown = now.select("id", "nodes", "rels").join(link.select(F.col("id").alias("rel"), "src", "dst"), F.col("id") == F.col("src")).filter(~F.array_contains("rels", F.col("rel")))
        now = grown.select(F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels"))
    if not out:
        return _empty(g)
    return reduce(DataFrame.union, out).select(F.struct("nodes", "rels").cast(PATH).alias("result"))


def _subgraph(g: PropertyGraph, start, config: dict) -> DataFrame:
    """(id, depth, valid) of what a breadth-first search reaches."""
    low, high = int(config.get("minHops", 0)), int(config.get("maxHops", -1))
    link = written(steps(g, config.get("relationshipFilter")).select("src", "dst").distinct(), "steps")
    marks = written(_marked(g, config.get("labelFilter")), "marks")
    front = written(g.V.join(g._ids(start), "id", "left_semi").select("id", F.lit(0).alias("depth")), "front")
    seen, depth = front, 0
    while (high < 0 or depth < high) and not front.isEmpty():
        going = front.join(marks, "id")
        going = going.filter("expand") if depth or config.get("filterStartNode", True) else going
        depth += 1
        nxt = link.join(going, link["src"] == going["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        front = written(nxt.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = written(seen.union(front), "seen")
    found = seen.join(marks, "id").filter(F.col("depth") >= low)
    return found.filter("valid" if config.get("filterStartNode", True) else "valid or depth = 0")


@register("path.subgraph_nodes")
def subgraph_nodes(g: PropertyGraph, start_node, config: dict | None = None) -> DataFrame:
    """(nodes): each node once; minHops is honoured."""
    return _subgraph(g, start_node, config or {}).select(F.col("id").alias("nodes"))


@register("path.subgraph_all")
def subgraph_all(g: PropertyGraph, start_node, config: dict | None = None) -> DataFrame:
    """(kind, id): the nodes, and the rels among them."""
    nodes = written(_subgraph(g, start_node, config or {}).select("id"), "nodes")
    e = g.E.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.select(F.lit("node").alias("kind"), "id").union(e.select(F.lit("rel"), "id"))


@register("path.create")
def create(g: PropertyGraph, start_node: int, rels: list[int | None]) -> DataFrame:
    """(path): rels one after another from start_node, until a null or one that doesn't touch the path's end."""
    wanted = [r for r in rels[: rels.index(None) if None in rels else len(rels)]]
    found = g.E.filter(F.col("id").isin(*wanted)) if wanted else g.E.limit(0)
    order = g.spark.createDataFrame([(i, r) for i, r in enumerate(wanted)], "i int, id long")
    links = order.join(found.select("id", "src", "dst"), "id", "left").agg(F.array_sort(F.collect_list(F.struct("i", "id", "src", "dst"))).alias("links"))
    zero = F.struct(F.array(F.lit(start_node).cast("long")).alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("rels"), F.lit(True).alias("open"))

    def step(p: Column, x: Column) -> Column:
        end = F.element_at(p["nodes"], -1)
        nxt = F.when(x["src"] == end, x["dst"]).when(x["dst"] == end, x["src"])
        grown = F.struct(F.concat(p["nodes"], F.array(nxt)).alias("nodes"), F.concat(p["rels"], F.array(x["id"])).alias("rels"), F.lit(True).alias("open"))
        return F.when(p["open"] & nxt.isNotNull(), grown).otherwise(F.struct(p["nodes"].alias("nodes"), p["rels"].alias("rels"), F.lit(False).alias("open")))

    return links.select(F.aggregate("links", zero, step, lambda p: F.struct(p["nodes"].alias("nodes"), p["rels"].alias("rels"))).cast(PATH).alias("path"))


@function("path.elements")
def elements(path: Column) -> Column:
    """Nodes and rels in turn."""
    return F.filter(F.flatten(F.transform(path["nodes"], lambda n, i: F.array(n, F.get(path["rels"], i)))), lambda x: x.isNotNull())


@function("path.combine")
def combine(first: Column, second: Column) -> Column:
    joined = F.struct(F.concat(first["nodes"], F.slice(second["nodes"], 2, 1 << 30)).alias("nodes"), F.concat(first["rels"], second["rels"]).alias("rels"))
    return _guard(F.element_at(first["nodes"], -1) == F.element_at(second["nodes"], 1), joined, "the paths don't meet")


@function("path.slice")
def slice_(path: Column, offset: int = 0, length: int = -1) -> Column:
    n = F.size(path["rels"]) - offset if length < 0 else F.lit(length)
    n = F.greatest(n, F.lit(0))
    return F.struct(F.slice(path["nodes"], offset + 1, n + 1).alias("nodes"), F.slice(path["rels"], F.lit(offset + 1), n).alias("rels"))


@register("algo.all_simple_paths")
def all_simple_paths(g: PropertyGraph, start_node: int, end_node: int, relationship_types: list[str], max_length: int) -> DataFrame:
    """(path): paths that visit no node twice."""
    link = written(steps(g, relationship_types), "steps")
    now = written(g.V.join(g._ids(start_node), "id", "left_semi").select("id", F.array("id").alias("nodes"), F.expr("cast(array() as array<bigint>)").alias("rels")), "paths")
    out = []
    for _ in range(max_length):
        grown = now.join(link.select(F.col("id").alias("rel"), "src", "dst"), F.col("id") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst")))
        now = written(grown.select(F.col("dst").alias("id"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("rels", F.array("rel")).alias("rels")), "paths")
        out.append(now.filter(F.col("id") == end_node).select("nodes", "rels"))
        now = now.filter(F.col("id") != end_node)
        if now.isEmpty():
            break
    return reduce(DataFrame.union, out).select(F.struct("nodes", "rels").cast(PATH).alias("path")) if out else _empty(g, "path")


@register("algo.astar")
def astar(g: PropertyGraph, start: int, target: int, config: dict | None = None) -> DataFrame:
    """(path, weight): a least-cost path over edges in either direction.

    The goal's estimate steers a search that visits one node at a time; here a
    whole frontier is relaxed at once, so it is used to drop what can't beat the
    best known cost.  Unreachable: the start alone, with weight 0.
    """
    c = {"unweighted": False, "epsilon": 1.0, "distance_prop": "distance", "heuristic_name": "", "latitude_name": "lat", "longitude_name": "lon", "whitelisted_labels": [], "blacklisted_labels": [], "relationships_filter": []} | (config or {})
    v = g.V.select("id", "labels")
    keep = F.lit(True)
    if c["blacklisted_labels"]:
        keep = keep & ~F.arrays_overlap("labels", F.array(*map(F.lit, c["blacklisted_labels"])))
    if c["whitelisted_labels"]:
        keep = keep & F.arrays_overlap("labels", F.array(*map(F.lit, c["whitelisted_labels"])))
    allowed = v.filter(keep | F.col("id").isin(start, target)).select("id")
    cost = g.E.select("id", (F.lit(10.0) if c["unweighted"] else prop(g.E, c["distance_prop"], "double")).alias("weight"))
    link = steps(g, c["relationships_filter"], allow_both=False).join(cost, "id")
    link = link.join(allowed.withColumnRenamed("id", "src"), "src", "left_semi").join(allowed.withColumnRenamed("id", "dst"), "dst", "left_semi")
    link = written(link.select("src", "dst", _guard(F.col("weight").isNotNull(), F.col("weight"), "an edge has no distance").alias("weight")), "steps")
    if link.filter(F.col("src") == start).isEmpty() and start != target:
        raise ValueError("the start node has no edge to go along")
    found = relax(link, g.spark.createDataFrame([(start, start)], "source long, id long")).filter(F.col("id") == target)
    alone = g.spark.createDataFrame([([start], 0.0)], "path array<long>, weight double")
    reached = found.select("path", F.col("distance").alias("weight"))
    return reached if not reached.isEmpty() else alone


def estimate(g: PropertyGraph, target: int, latitude: str = "lat", longitude: str = "lon") -> DataFrame:
    """(id, km): great-circle distance to target, the admissible estimate of A*."""
    v = g.V.select("id", prop(g.V, latitude, "double").alias("lat"), prop(g.V, longitude, "double").alias("lon"))
    t = v.filter(F.col("id") == target).select(F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
    return v.crossJoin(F.broadcast(t)).select("id", haversine(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"), 6371.0).alias("km"))  # one row


@register("algo.cover", "graph_util.connect_nodes")
def cover(g: PropertyGraph, nodes) -> DataFrame:
    """(rel): edges with both ends among nodes."""
    return g.subgraph(nodes).E.select(F.col("id").alias("rel"))


@register("neighbors.at_hop")
def at_hop(g: PropertyGraph, node, rel_type: list[str], distance: int) -> DataFrame:
    """(nodes): those at exactly that distance."""
    found = levels(steps(g, rel_type, allow_both=False), g._ids(node), distance)
    return found.filter(F.col("depth") == distance).select(F.col("id").alias("nodes"))


@register("neighbors.by_hop")
def by_hop(g: PropertyGraph, node, rel_type: list[str], distance: int) -> DataFrame:
    """(depth, nodes): a sorted list for each hop from 1 to distance, empty ones too."""
    found = levels(steps(g, rel_type, allow_both=False), g._ids(node), distance).filter("depth > 0")
    lists = found.groupBy("depth").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    every = g.spark.range(1, distance + 1).select(F.col("id").cast("int").alias("depth"))
    return every.join(lists, "depth", "left").select("depth", F.coalesce("nodes", F.expr("cast(array() as array<bigint>)")).alias("nodes"))


@register("graph_util.descendants")
def descendants(g: PropertyGraph, node) -> DataFrame:
    """(descendants): what is reachable; the start too if it lies on a cycle."""
    return levels(g.E, g._ids(node), keep_seeds=False).select(F.col("id").alias("descendants"))


@register("graph_util.ancestors")
def ancestors(g: PropertyGraph, node) -> DataFrame:
    back = g.E.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return levels(back, g._ids(node), keep_seeds=False).select(F.col("id").alias("ancestors"))


@register("nxalg.ancestors")
def nx_ancestors(g: PropertyGraph, source: int) -> DataFrame:
    return ancestors(g, source).filter(F.col("ancestors") != source)


@register("nxalg.descendants")
def nx_descendants(g: PropertyGraph, source: int) -> DataFrame:
    return descendants(g, source).filter(F.col("descendants") != source)


def topological_levels(g: PropertyGraph, reverse: bool = False) -> DataFrame:
    """(id, level): the length of the longest path to each node; a cycle raises."""
    e = g.E.select("src", "dst") if not reverse else g.E.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    left_v, left_e = written(g.V.select("id"), "left"), written(e.distinct(), "links")
    out, level = None, 0
    while not left_v.isEmpty():
        free = written(left_v.join(left_e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)), "free")
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        out = free if out is None else written(out.union(free), "sorted")
        left_v = written(left_v.join(free, "id", "left_anti"), "left")
        left_e = written(left_e.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "links")
        level += 1
    return out if out is not None else g.V.select("id", F.lit(0).alias("level")).limit(0)


@register("graph_util.topological_sort")
def topological_sort(g: PropertyGraph) -> DataFrame:
    """(sorted_nodes): one list, by level and id."""
    order = topological_levels(g).agg(F.array_sort(F.collect_list(F.struct("level", "id"))).alias("o"))
    return order.select(F.transform("o", lambda x: x["id"]).alias("sorted_nodes"))


@register("nxalg.topological_sort")
def nx_topological_sort(g: PropertyGraph) -> DataFrame:
    return topological_sort(g).withColumnRenamed("sorted_nodes", "nodes")


@register("igraphalg.topological_sort")
def igraph_topological_sort(g: PropertyGraph, mode: str = "out") -> DataFrame:
    if mode not in ("out", "in"):
        raise ValueError("mode is out or in")
    order = topological_levels(g, mode == "in").agg(F.array_sort(F.collect_list(F.struct("level", "id"))).alias("o"))
    return order.select(F.transform("o", lambda x: x["id"]).alias("nodes"))


@register("graph_util.chain_nodes", kind="write")
def chain_nodes(g: PropertyGraph, nodes: list[int], edge_type: str) -> PropertyGraph:
    """The graph with an edge from each of nodes to the next."""
    from .writes import with_edges

    return with_edges(g, g.spark.createDataFrame([(a, b) for a, b in zip(nodes, nodes[1:], strict=False)], "src long, dst long").withColumn("type", F.lit(edge_type)))
