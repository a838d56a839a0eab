"""Components, cut edges and vertices, cycles, matching; and subgraphs by degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..kernels import exact
from ..plans.lineage import written
from ..plans.loops import apply_per_component, between, components, peel, trim, two_sided
from ..registry import register


@register("weakly_connected_components.get")
def wcc(g: PropertyGraph) -> DataFrame:
    """(node, component_id): the least id of its component."""
    return components(g.V, g.E).select(F.col("id").alias("node"), F.col("component").alias("component_id"))


@register("nxalg.weakly_connected_components_subgraph")
def wcc_subgraph(g: PropertyGraph, vertices, edges) -> DataFrame:
    """(n_components, components: sorted lists of ids) of the given vertices and edges."""
    found = components(*_parts(g.subgraph(vertices, edges)))
    lists = found.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("c"))
    return lists.agg(F.count(F.lit(1)).alias("n_components"), F.array_sort(F.collect_list("c")).alias("components"))


def _parts(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    return g.V, g.E


def _hanging(g: PropertyGraph) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Edges to what hangs on by one neighbour ((id, src, dst, a, b: its lesser and greater end, m: how many there are of them), None in
    a small graph), and vertices and edges of the rest."""
    rounds, left = peel(g.E)
    if not rounds:
        return None, g.V, g.E
    off = None
    for r in rounds:
        r = r.select(F.least("leaf", "parent").alias("a"), F.greatest("leaf", "parent").alias("b"), "m")
        off = r if off is None else off.union(r)
    e = g.E.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).select("id", "src", "dst", "a", "b")
    rest = written(between(g.E.select("id", "src", "dst"), left), "rest")
    return e.join(off.hint("shuffle_hash"), ["a", "b"]), rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct(), rest


@register("biconnected_components.get")
def biconnected(g: PropertyGraph) -> DataFrame:
    """(bcc_id, node_from, node_to): every edge's component; ids are the least edge of each.

    Links to what hangs on by one neighbour are components of their own.
    """
    off, v, e = _hanging(g)
    found = apply_per_component(v, e, exact.biconnected_edges, "bcc_id long, node_from long, node_to long")
    if off is None:
        return found
    several = off.filter("m > 1").groupBy("a", "b").agg(F.min("id").alias("bcc_id"), F.collect_list(F.struct("src", "dst")).alias("ends")).select("bcc_id", F.inline("ends"))
    return found.union(off.filter("m = 1").select("id", "src", "dst")).union(several)


@register("nxalg.biconnected_components")
def nx_biconnected(g: PropertyGraph) -> DataFrame:
    """(components): the vertices of each component, sorted."""
    ends = biconnected(g).select("bcc_id", F.explode(F.array("node_from", "node_to")).alias("n"))
    return ends.groupBy("bcc_id").agg(F.array_sort(F.collect_set("n")).alias("components")).select("components")


@register("bridges.get")
def bridges(g: PropertyGraph) -> DataFrame:
    """(node_from, node_to): edges whose loss parts their component; parallel edges never are."""
    off, v, e = _hanging(g)
    found = apply_per_component(v, e, exact.bridges, "node_from long, node_to long")
    return found if off is None else found.union(off.filter("m = 1").select("src", "dst"))


@register("nxalg.bridges")
def nx_bridges(g: PropertyGraph, root: int | None = None) -> DataFrame:
    """(bridges: [a, b]); with root, those of its component."""
    found = bridges(g)
    if root is not None:
        own = components(g.V, g.E)
        home = own.join(own.filter(F.col("id") == root).select("component"), "component", "left_semi").select(F.col("id").alias("node_from"))
        found = found.join(home, "node_from", "left_semi")
    return found.select(F.array("node_from", "node_to").alias("bridges"))


@register("cycles.get")
def cycles(g: PropertyGraph) -> DataFrame:
    """(cycle_id, node, position): simple cycles when directions are ignored, from each one's least node on.

    Two nodes with several edges between them are a cycle, as is a self-loop.
    """
    found = apply_per_component(g.V, g.E, exact.undirected_cycles, "key string, nodes array<long>")
    return found.select(F.xxhash64("key").alias("cycle_id"), F.posexplode("nodes").alias("position", "node")).select("cycle_id", "node", "position")


@register("nxalg.simple_cycles")
def simple_cycles(g: PropertyGraph) -> DataFrame:
    """(cycles): directed simple cycles, from each one's least node on."""
    return apply_per_component(g.V, g.E, exact.directed_cycles, "cycles array<long>")


@register("nxalg.find_cycle")
def find_cycle(g: PropertyGraph, source: int | None = None, orientation: str | None = None) -> DataFrame:
    """(cycle): one cycle as a list of nodes, or no row."""
    find = lambda nodes, edges: exact.one_cycle(nodes, edges, source, orientation == "ignore")
    return apply_per_component(g.V, g.E, find, "cycle array<long>").orderBy("cycle").limit(1)


@register("bipartite_matching.max")
def max_matching(g: PropertyGraph) -> DataFrame:
    """(maximum_bipartite_matching); 0 if any component isn't bipartite."""
    sizes = apply_per_component(g.V, g.E, exact.matching_size, "size long")
    total = F.when(F.min("size") < 0, 0).otherwise(F.coalesce(F.sum("size"), F.lit(0)))
    return sizes.agg(total.cast("long").alias("maximum_bipartite_matching"))


@register("nxalg.is_bipartite")
def is_bipartite(g: PropertyGraph) -> DataFrame:
    return two_sided(g.E).select(F.col("ok").alias("is_bipartite"))


def strong_labels(g: PropertyGraph) -> DataFrame:
    """(id, label) of vertices that may be strongly connected to others; the rest are alone."""
    e = trim(g.E).withColumn("id", F.lit(0).cast("long"))
    v = written(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), "vertices")
    return written(apply_per_component(v, e, exact.strong_labels, "id long, label long"), "strong")


@register("nxalg.strongly_connected_components")
def scc(g: PropertyGraph) -> DataFrame:
    """(components): sorted lists of ids."""
    labels = strong_labels(g)
    alone = g.V.select("id").join(labels.select("id").hint("merge"), "id", "left_anti").select("id", F.col("id").alias("label"))
    labels = labels.union(alone)
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("components")).select("components")


def core_table(g: PropertyGraph) -> DataFrame:
    """(id, core) by the fixpoint of h-indices: a vertex's next value is the largest h such that h neighbours have h or more."""
    links = written(g.undirected().select("src", "dst").filter("src <> dst").distinct(), "links")
    now = written(g.V.select("id").join(links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core")), "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core")), "core")
    while True:
        # Counting neighbours by value keeps a hub's rows at as many as there are values.
        held = links.join(now, links["dst"] == now["id"]).groupBy("src", "core").agg(F.count(F.lit(1)).alias("n"))
        ordered = held.groupBy("src").agg(F.reverse(F.array_sort(F.collect_list(F.struct("core", "n")))).alias("h"))
        h = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("best")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.greatest(a["best"], F.least(x["core"], a["seen"] + x["n"])).alias("best")), lambda a: a["best"])
        nxt = written(now.join(ordered.select(F.col("src").alias("id"), h.alias("new")), "id", "left").select("id", F.col("core").alias("was"), F.least("core", F.coalesce("new", F.lit(0))).alias("core")), "core")
        now = nxt.select("id", "core")
        if nxt.filter("core < was").isEmpty():
            return now


@register("nxalg.core_number")
def core_number(g: PropertyGraph) -> DataFrame:
    return core_table(g).select(F.col("id").alias("node"), "core")


def kernel(name: str, run, schema: str, doc: str, per_graph: bool = False):
    """Register an exact sequential algorithm that is run on each component."""

    @register(name)
    def call(g: PropertyGraph) -> DataFrame:
        return apply_per_component(g.V, g.E, run, schema)

    call.__doc__ = doc
    return call


find_cliques = kernel("nxalg.find_cliques", exact.maximal_cliques, "cliques array<long>", "(cliques): maximal cliques, sorted.")


@register("nxalg.chain_decomposition")
def chain_decomposition(g: PropertyGraph, root: int | None = None) -> DataFrame:
    """(chains: list of [a, b]) of a depth-first search from the least vertex of each component, or from root alone."""
    return apply_per_component(g.V, g.E, lambda n, e: exact.chains(n, e, root), "chains array<array<long>>")


@register("nxalg.k_clique_communities")
def k_clique_communities(g: PropertyGraph, k: int, cliques=None) -> DataFrame:
    """(communities): unions of k-cliques that share k - 1 vertices."""
    if k < 2:
        raise ValueError("k must be 2 or more")
    return apply_per_component(g.V, g.E, lambda n, e: exact.clique_communities(n, e, k), "communities array<long>")


@register("nxalg.k_edge_components")
def k_edge_components(g: PropertyGraph, k: int) -> DataFrame:
    """(components): largest sets whose every two vertices have k edge-disjoint paths each way."""
    if k < 1:
        raise ValueError("k must be positive")
    return apply_per_component(g.V, g.E, lambda n, e: exact.edge_components(n, e, k), "components array<long>")


@register("nxalg.k_components")
def k_components(g: PropertyGraph, density: float = 0.95) -> DataFrame:
    """(k, components): for each k the maximal sets that no k - 1 vertices part."""
    return apply_per_component(g.V, g.E, exact.vertex_components, "k long, components array<long>")


@register("nxalg.node_connectivity")
def node_connectivity(g: PropertyGraph, source: int | None = None, target: int | None = None) -> DataFrame:
    """(connectivity): fewest vertices whose loss parts the (directed) graph, or target from source."""
    if (source is None) != (target is None):
        raise ValueError("give both source and target, or neither")
    parts = components(g.V, g.E).select("component").distinct().limit(2).count()
    if source is None and parts > 1:
        return g.spark.createDataFrame([(0,)], "connectivity long")
    found = apply_per_component(g.V, g.E, lambda n, e: exact.vertex_connectivity(n, e, source, target), "connectivity long")
    return found.agg(F.coalesce(F.max("connectivity"), F.lit(0)).cast("long").alias("connectivity"))
