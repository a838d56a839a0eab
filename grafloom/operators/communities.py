"""Communities by Louvain and Leiden, colouring, clustering of vectors and spectral cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import co_located, dealt, written
from ..plans.loops import components
from ..registry import register


def _links(g: PropertyGraph, weight: str | None) -> DataFrame:
    """(src, dst, w) in both directions, parallel edges summed; a self-loop counts double, as in both directions."""
    e = g.E.select("src", "dst", g.weight(weight).alias("w"))
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return written(both.groupBy("src", "dst").agg(F.sum("w").alias("w")), "links")


def modularity(links: DataFrame, label: DataFrame, gamma: float = 1.0) -> float:
    """Of label (id, c): what share of weight is within communities beyond what degrees would give."""
    a = links.join(label.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    row = a.groupBy("cs").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside")).agg(F.sum("k").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return row["inside"] / row["m2"] - gamma * row["kk"] / row["m2"] ** 2 if row["m2"] else 0.0


def _move(links: DataFrame, label: DataFrame, gamma: float, parity: int, m2: float) -> DataFrame:
    """One round: each vertex of one parity class joins the neighbouring community of most gain (the least id of equals).

    Only a hashed half moves at a time, and alone vertices only join lesser
    ones, so that two can't swap for ever.
    """
    deg = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    own = label.join(deg, "id")
    tot = own.groupBy("c").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("n"))
    to = links.filter("src <> dst").join(label.select(F.col("id").alias("dst"), F.col("c").alias("tc")), "dst").groupBy("src", "tc").agg(F.sum("w").alias("win"))
    seen = own.join(tot, "c").select("id", "c", "k", F.col("n").alias("own_n"))
    offer = to.join(seen, to["src"] == seen["id"]).join(tot.select(F.col("c").alias("tc"), "tot", "n"), "tc")
    rest = F.when(F.col("tc") == F.col("c"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
    offer = offer.withColumn("gain", F.round(F.col("win") - gamma * F.col("k") * rest / m2, 10))
    best = offer.groupBy("id").agg(F.max(F.struct("gain", F.negative("tc").alias("t"))).alias("b"), F.max(F.when(F.col("tc") == F.col("c"), F.col("gain"))).alias("stay"), F.first("k").alias("k"), F.first("own_n").alias("own_n"))
    best = best.select("id", F.negative("b.t").alias("to"), F.col("b.gain").alias("gain"), F.coalesce("stay", F.lit(0.0)).alias("stay"), "own_n").join(tot.select(F.col("c").alias("to"), F.col("n").alias("to_n")), "to")
    moves = best.filter((F.col("gain") > F.col("stay")) & (F.pmod(F.xxhash64("id", F.lit(parity // 2)), F.lit(2)) == parity % 2)).select("id", F.col("to"), "own_n", "to_n")
    return label.join(moves, "id", "left").select("id", F.when(F.col("to").isNotNull() & ~((F.col("own_n") == 1) & (F.col("to_n") == 1) & (F.col("to") > F.col("c"))), F.col("to")).otherwise(F.col("c")).alias("c"))


def louvain(g: PropertyGraph, weight: str | None, threshold: float, gamma: float = 1.0, max_phases: int = 20, max_moves: int = 20, refine: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(id, c) of the last phase, and of each phase."""
    links = _links(g, weight)
    row = links.agg(F.sum("w")).first()[0]
    whole = written(links.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")), "whole")
    if not row:
        return whole, []
    level, phases, last = links, [], modularity(links, whole, gamma)
    for _ in range(max_phases):
        label = written(level.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")), "label")
        was = modularity(level, label, gamma)
        for r in range(max_moves):
            label = written(_move(level, label, gamma, r, row), "label")
            if r % 2:
                now = modularity(level, label, gamma)
                if now - was < threshold:
                    break
                was = now
        if refine:
            # A community is split into its connected parts, which is what Leiden guarantees.
            inside = level.join(label.select(F.col("id").alias("src"), "c"), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").filter("c = cd")
            label = written(components(label.select("id"), inside).select("id", F.col("component").alias("c")), "refined")
        now = modularity(level, label, gamma)
        if now - last < threshold:
            break
        last = now
        whole = written(whole.join(label.select(F.col("id").alias("c"), F.col("c").alias("n")), "c").select("id", F.col("n").alias("c")), "whole")
        phases.append(whole)
        folded = level.join(label.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
        level = written(folded.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "level")
    least = whole.groupBy("c").agg(F.min("id").alias("least"))
    return written(whole.join(least, "c").select("id", F.col("least").alias("c")), "whole"), phases


@register("community_detection.get")
def community_detection(g: PropertyGraph, weight: str = "weight", coloring: bool = False, min_graph_shrink: int = 100000, community_alg_threshold: float = 1e-6, coloring_alg_threshold: float = 0.01, num_of_threads: int | None = None) -> DataFrame:
    """(node, community_id: its least node) of nodes with edges, by Louvain."""
    label, _ = louvain(g, weight, community_alg_threshold)
    return label.select(F.col("id").alias("node"), F.col("c").alias("community_id"))


@register("community_detection.get_subgraph")
def community_detection_subgraph(g: PropertyGraph, subgraph_nodes, subgraph_relationships, **options) -> DataFrame:
    return community_detection(g.subgraph(subgraph_nodes, subgraph_relationships), **options)


@register("leiden_community_detection.get")
def leiden(g: PropertyGraph, weight_property: str = "weight", gamma: float = 1.0, theta: float = 0.01, resolution_parameter: float = 0.01, number_of_iterations: int = 20) -> DataFrame:
    """(node, community_id, communities: the id at each level); every community is connected."""
    label, phases = louvain(g, weight_property, 1e-9, gamma, max_phases=min(number_of_iterations, 20), refine=True)
    if not phases:
        raise ValueError("no communities")
    out = label
    for i, p in enumerate(phases):
        out = out.join(p.select("id", F.col("c").alias(f"c{i}")), "id")
    return out.select(F.col("id").alias("node"), F.col("c").alias("community_id"), F.array(*[f"c{i}" for i in range(len(phases))]).alias("communities"))


@register("leiden_community_detection.get_subgraph")
def leiden_subgraph(g: PropertyGraph, subgraph_nodes, subgraph_relationships, **options) -> DataFrame:
    return leiden(g.subgraph(subgraph_nodes, subgraph_relationships), **options)


@register("cugraph.louvain.get")
def louvain_gpu(g: PropertyGraph, max_iterations: int = 100, resolution: float = 1.0) -> DataFrame:
    label, _ = louvain(g, None, 1e-7, resolution, max_phases=max_iterations)
    return label.select(F.col("id").alias("node"), F.col("c").alias("partition"))


@register("cugraph.leiden.get")
def leiden_gpu(g: PropertyGraph, max_iterations: int = 100, resolution: float = 1.0, theta: float = 1.0) -> DataFrame:
    label, _ = louvain(g, None, 1e-7, resolution, max_phases=max_iterations, refine=True)
    return label.select(F.col("id").alias("node"), F.col("c").alias("partition"))


@register("igraphalg.community_leiden")
def igraph_leiden(g: PropertyGraph, objective_function: str = "CPM", weights: str | None = None, resolution_parameter: float = 1.0, beta: float = 0.01, initial_membership=None, n_iterations: int = 2, node_weights=None) -> DataFrame:
    """(node, community_id) of all nodes; the objective is modularity with that resolution, for CPM divided by the mean degree squared."""
    if objective_function not in ("CPM", "modularity"):
        raise ValueError("objective_function is CPM or modularity")
    if initial_membership is not None or node_weights is not None:
        raise ValueError("neither a starting membership nor node weights are taken")
    gamma = resolution_parameter
    if objective_function == "CPM":
        total = 2 * (g.E.agg(F.sum(g.weight(weights) if weights else F.lit(1.0))).first()[0] or 0.0)
        degree = total / max(1, g.V.count())
        gamma = resolution_parameter * total / degree**2 if degree else resolution_parameter
    label, _ = louvain(g, weights, 1e-9, gamma, refine=True)
    return g.V.select("id").join(label, "id", "left").select(F.col("id").alias("node"), F.coalesce("c", "id").alias("community_id"))


def _spectral(g: PropertyGraph, clusters: int, rounds: int, weight: str | None) -> DataFrame:
    from pyspark.ml.clustering import PowerIterationClustering

    e = g.E.select("src", "dst", g.weight(weight).alias("weight")).filter("src <> dst")
    return PowerIterationClustering(k=clusters, maxIter=rounds, srcCol="src", dstCol="dst", weightCol="weight", initMode="degree").assignClusters(e).select(F.col("id").alias("node"), "cluster")


@register("cugraph.balanced_cut_clustering.get")
def balanced_cut(g: PropertyGraph, num_clusters: int, num_eigenvectors: int = 2, ev_tolerance: float = 1e-5, ev_max_iter: int = 40, kmean_tolerance: float = 1e-5, kmean_max_iter: int = 100, weight_property: str = "weight") -> DataFrame:
    """(node, cluster) by ev_max_iter rounds of power iteration, an approximation of the spectral cut."""
    return _spectral(g, num_clusters, ev_max_iter, weight_property)


@register("cugraph.spectral_clustering.get")
def spectral(g: PropertyGraph, num_clusters: int, num_eigenvectors: int = 2, ev_tolerance: float = 1e-5, ev_max_iter: int = 40, kmean_tolerance: float = 1e-5, kmean_max_iter: int = 20, weight_property: str = "weight") -> DataFrame:
    return _spectral(g, num_clusters, ev_max_iter, weight_property)


@register("cugraph.generator.rmat")
def rmat(g: PropertyGraph, scale: int = 4, num_edges: int = 100, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 42, clip_and_flip: bool = False) -> DataFrame:
    """(source, target): edges that choose a quadrant of the adjacency matrix scale times over."""
    edges = g.spark.range(num_edges)
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(scale):
        u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(level)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
        down, right = F.when(u >= a + b, 1).otherwise(0), F.when(((u >= a) & (u < a + b)) | (u >= a + b + c), 1).otherwise(0)
        src, dst = src * 2 + down, dst * 2 + right
    out = edges.select(src.alias("source"), dst.alias("target"))
    return out.select(F.greatest("source", "target").alias("source"), F.least("source", "target").alias("target")) if clip_and_flip else out


def colour_rounds(g: PropertyGraph, colours: int | None = None, weight: str | None = None, by_degree: bool = True) -> DataFrame:
    """(id, color): Jones and Plassmann's rounds; who outranks all undecided neighbours takes the least free colour.

    That is what greedy colouring gives in order of rank: degree, then a hash, or
    the hash alone.  With so many colours only, who finds none free takes the one
    that the least weight of edges to decided neighbours has, the least of equals.
    """
    e = written(g.E.select("src", "dst", g.weight(weight).alias("w") if weight else F.lit(1.0).alias("w")).filter("src <> dst"), "edges")
    both, rows = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), 2 * e.count()
    # Dealt out by dst once, in all of the rounds' joins.
    link = co_located(written(dealt(both, rows, "src", "dst").groupBy("src", "dst").agg(F.sum("w").alias("w")), "links"), "dst", rows)
    deg = link.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    order = F.coalesce("d", F.lit(0)) if by_degree else F.lit(0)
    rank = g.V.select("id").join(deg, "id", "left").select("id", F.struct(order.alias("d"), F.xxhash64("id").alias("h"), "id").alias("rank"))
    rank = written(rank, "rank")
    done = g.spark.createDataFrame([], "id long, color long")
    todo = rank
    while not todo.isEmpty():
        near = link.join(todo.select(F.col("id").alias("dst"), F.col("rank").alias("other")), "dst").groupBy(F.col("src").alias("id")).agg(F.max("other").alias("top"))
        now = todo.join(near, "id", "left").filter("top is null or rank > top").select("id")
        spent = link.join(done.select(F.col("id").alias("dst"), "color"), "dst").groupBy(F.col("src").alias("id"), "color").agg(F.sum("w").alias("w"))
        used = spent.groupBy("id").agg(F.collect_set("color").alias("used"), F.min(F.struct("w", "color")).alias("cheapest"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0).cast("long"), F.size("used").cast("long")), F.col("used")))
        if colours is not None:
            free = F.when(free < colours, free).otherwise(F.col("cheapest.color"))
        fresh = written(now.join(used, "id", "left").select("id", F.when(F.col("used").isNull(), F.lit(0).cast("long")).otherwise(free).alias("color")), "fresh")
        done = written(done.union(fresh), "coloured")
        todo = written(todo.join(fresh, "id", "left_anti"), "todo")
    link.unpersist()
    return done


@register("graph_coloring.color_graph")
def color_graph(g: PropertyGraph, parameters: dict | None = None, edge_property: str = "weight") -> DataFrame:
    """(node, color): neighbours differ, and the number of colours is what that takes here.

    With no_of_colors among the parameters there are no more than that, and edges
    of little edge_property are the first to have like ends where they don't
    suffice.  The other parameters steer a search that isn't made here.
    """
    colours = (parameters or {}).get("no_of_colors")
    if colours is not None and colours < 1:
        raise ValueError("no_of_colors is 1 at least")
    return colour_rounds(g, colours, edge_property).select(F.col("id").alias("node"), "color")


@register("graph_coloring.color_subgraph")
def color_subgraph(g: PropertyGraph, vertices, edges, parameters: dict | None = None, edge_property: str = "weight") -> DataFrame:
    return color_graph(g.subgraph(vertices, edges), parameters, edge_property)


@register("nxalg.greedy_color")
def greedy_color(g: PropertyGraph, strategy: str = "largest_first", interchange: bool = False) -> DataFrame:
    """(node, color): greedy, in the order of degrees (largest_first) or of hashes (random_sequential); other strategies are refused."""
    if strategy not in ("largest_first", "random_sequential") or interchange:
        raise ValueError("strategy is largest_first or random_sequential, without interchange")
    return colour_rounds(g, by_degree=strategy == "largest_first").select(F.col("id").alias("node"), "color")


@register("kmeans.get_clusters")
def get_clusters(g: PropertyGraph, n_clusters: int, embedding_property: str = "embedding", init: str = "k-means++", n_init: int = 10, max_iter: int = 10, tol: float = 1e-4, algorithm: str = "lloyd", random_state: int = 1998) -> DataFrame:
    """(node, cluster_id)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .similarity import _vectors

    data = written(_vectors(g, embedding_property), "vectors").select("id", array_to_vector("v").alias("features"))
    model = KMeans(k=n_clusters, maxIter=max_iter, tol=tol, seed=random_state).fit(data)
    return model.transform(data).select(F.col("id").alias("node"), F.col("prediction").cast("long").alias("cluster_id"))


@register("kmeans.set_clusters", kind="write")
def set_clusters(g: PropertyGraph, n_clusters: int, embedding_property: str = "embedding", cluster_property: str = "cluster_id", **options) -> PropertyGraph:
    """The graph with each node's cluster as a column."""
    found = get_clusters(g, n_clusters, embedding_property, **options).select(F.col("node").alias("id"), F.col("cluster_id").alias(cluster_property))
    return PropertyGraph(g.V.drop(cluster_property).join(found, "id", "left"), g.E)
