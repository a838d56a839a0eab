import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from grafloom.graph import PropertyGraph
from grafloom.kernels import exact
from grafloom.operators.nxalg import TRIADS, triad
from grafloom.registry import load_all


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    return PropertyGraph.of(spark, list(range(5)), [(i, i + 1) for i in range(4)])


@pytest.fixture(scope="module")
def people(spark):
    vs = [(0, ["Dog"], {"name": "Rex", "age": 3}), (1, ["Cat"], {"name": "Tom"}), (2, ["Mouse"], {"name": "Jerry"}), (3, ["Dog", "Old"], {"name": "Fido", "age": 9})]
    es = [(0, 1, "HUNTS", {"w": 2}), (1, 2, "CATCHES", {}), (0, 3, "FRIENDS", {}), (3, 0, "FRIENDS", {}), (3, 1, "HUNTS", {"w": 5})]
    return PropertyGraph.of(spark, vs, es)


def test_every_operator_of_the_blueprint_is_registered():
    assert len(load_all()) >= 320


def test_pagerank_of_a_chain(chain):
    got = [r for _, r in rows(chain.call("pagerank.get"), "node", "rank")]
    assert got == pytest.approx([0.081, 0.15, 0.209, 0.259, 0.301], abs=1e-3)
    with pytest.raises(ValueError):
        chain.call("pagerank.get", num_of_threads=0)


def test_degrees(chain):
    assert [d for _, d in rows(chain.call("degree_centrality.get"))] == [0.25, 0.5, 0.5, 0.5, 0.25]
    with pytest.raises(ValueError):
        chain.call("degree_centrality.get", type="sideways")


def test_betweenness_of_a_path_and_online(spark):
    g = PropertyGraph.of(spark, list(range(6)), [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)])
    want = [0.0, 0.0, 6.0, 6.0, 0.0, 0.0]
    assert [b for _, b in rows(g.call("betweenness_centrality.get", directed=False, normalized=False))] == pytest.approx(want)
    g.call("betweenness_centrality_online.reset")
    assert [b for _, b in rows(g.call("betweenness_centrality_online.set", False))] == pytest.approx(want)
    h = PropertyGraph.of(spark, list(range(8)), [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (1, 4), (6, 7)])
    with pytest.raises(ValueError):
        h.call("betweenness_centrality_online.get", False)
    got = rows(h.call("betweenness_centrality_online.update", False))
    assert [b for _, b in got] == pytest.approx([b for _, b in rows(h.call("betweenness_centrality.get", directed=False, normalized=False))])


def test_katz_without_edges_and_without_convergence(spark):
    assert rows(PropertyGraph.of(spark, [0, 1], []).call("katz_centrality.get")) == [(0, 0.0), (1, 0.0)]
    ring = PropertyGraph.of(spark, [0, 1, 2], [(0, 1), (1, 2), (2, 0)])
    with pytest.raises(ValueError):
        ring.call("katz_centrality.get", alpha=0.99, epsilon=1e-9, max_rounds=4)


def random_edges(seed, n=9, m=14, loops=False):
    rng = random.Random(seed)
    return [(i, a, b, 1.0) for i, (a, b) in enumerate((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if loops or a != b]


def parts(nodes, edges):
    adj = exact._sets(nodes, edges)
    return len(exact._pieces(adj, set(nodes)))


@pytest.mark.parametrize("seed", range(25))
def test_kernels_against_brute_force(seed):
    nodes, edges = list(range(9)), random_edges(seed)
    many = Counter(frozenset(e[1:3]) for e in edges)
    cut = sorted((a, b) for i, a, b, _ in edges if many[frozenset((a, b))] == 1 and parts(nodes, [e for e in edges if e[0] != i]) > parts(nodes, edges))
    assert sorted(exact.bridges(nodes, edges)) == cut
    adj = exact._sets(nodes, edges)
    cliques = [set(c) for k in range(1, 10) for c in itertools.combinations(nodes, k) if all(b in adj[a] for a, b in itertools.combinations(c, 2))]
    assert sorted(c[0] for c in exact.maximal_cliques(nodes, edges)) == sorted(sorted(c) for c in cliques if not any(c < d for d in cliques))
    out = exact.directed(nodes, edges)
    found = set()

    def walk(path):
        for y in out[path[-1]]:
            if y == path[0]:
                found.add(tuple(path))
            elif y > path[0] and y not in path:
                walk([*path, y])

    for n in nodes:
        walk([n])
    assert sorted(tuple(c) for (c,) in exact.directed_cycles(nodes, edges)) == sorted(found)
    reach = {n: set(_reach(out, n)) for n in nodes}
    label = dict(exact.strong_labels(nodes, edges))
    assert all((label[a] == label[b]) == (b in reach[a] and a in reach[b]) for a in nodes for b in nodes)
    groups = defaultdict(set)
    for k, a, b in exact.biconnected_edges(nodes, edges):
        groups[k].add(frozenset((a, b)))
    for one, two in itertools.combinations({e for g in groups.values() for e in g}, 2):
        together = any(one in g and two in g for g in groups.values())
        on_cycle = any(one in c and two in c for c in _cycles(nodes, adj))
        assert together == on_cycle


def _reach(out, start):
    seen, todo = {start}, [start]
    while todo:
        for y in out[todo.pop()]:
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def _cycles(nodes, adj):
    found = []

    def walk(path):
        for y in adj[path[-1]]:
            if y == path[0] and len(path) > 2:
                found.append({frozenset((path[i], path[(i + 1) % len(path)])) for i in range(len(path))})
            elif y > path[0] and y not in path:
                walk([*path, y])

    for n in nodes:
        walk([n])
    return found


def test_planarity():
    full = lambda n: {a: {b for b in range(n) if b != a} for a in range(n)}
    k33 = {a: {b for b in range(6) if (a < 3) != (b < 3)} for a in range(6)}
    grid = {(i, j): {(i + a, j + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < 5 and 0 <= j + b < 5} for i in range(5) for j in range(5)}
    number = {x: k for k, x in enumerate(sorted(grid))}
    assert exact.is_planar(full(4)) and not exact.is_planar(full(5)) and not exact.is_planar(k33)
    assert exact.is_planar({number[x]: {number[y] for y in ys} for x, ys in grid.items()})
    assert exact.is_planar({a: k33[a] - ({3} if a == 0 else {0} if a == 3 else set()) for a in k33})


@pytest.mark.parametrize("seed", range(8))
def test_matching_and_flow(seed):
    rng = random.Random(seed)
    edges = [(i, rng.randrange(6), 10 + rng.randrange(6), 1.0) for i in range(12)]
    nodes = sorted({x for e in edges for x in e[1:3]})

    def best(left, used):
        return 0 if not left else max([best(left[1:], used)] + [1 + best(left[1:], used | {b}) for _, a, b, _ in edges if a == left[0] and b not in used])

    want = best([n for n in nodes if n < 10], frozenset())
    comps = exact._pieces(exact._sets(nodes, edges), set(nodes))
    assert sum(next(exact.matching_size(sorted(c), [e for e in edges if e[1] in c]))[0] for c in comps) == want
    net = exact.FlowNet()
    caps = {}
    for i, a, b, _ in random_edges(seed, 7, 16):
        caps[i] = (a, b, rng.randint(1, 5))
        net.edge(a, b, caps[i][2])
    cut = min(sum(c for a, b, c in caps.values() if a in s and b not in s) for k in range(6) for extra in itertools.combinations([1, 2, 3, 4, 5], k) for s in [{0, *extra}])
    assert net.flow(0, 6) == pytest.approx(cut)


def test_structure_on_small_graphs(spark):
    g = PropertyGraph.of(spark, list(range(7)), [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5)])
    assert rows(g.call("weakly_connected_components.get")) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 5), (6, 6)]
    assert rows(g.call("bridges.get")) == [(2, 3)]
    assert rows(g.call("cycles.get").groupBy("cycle_id").agg(F.array_sort(F.collect_list("node")).alias("c")), "c") == [([0, 1, 2],), ([3, 4],), ([5, 5],)]
    assert g.call("bipartite_matching.max").first()[0] == 0
    assert rows(g.call("nxalg.core_number")) == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1), (5, 0), (6, 0)]
    assert rows(g.call("nxalg.strongly_connected_components")) == [([0, 1, 2],), ([3, 4],), ([5],), ([6],)]
    assert rows(g.call("nxalg.isolates")) == [(6,)]
    empty = PropertyGraph.of(spark, [], [])
    assert empty.call("weakly_connected_components.get").count() == 0 and empty.call("bipartite_matching.max").first()[0] == 0


def test_colouring_is_valid_and_communities_are_found(spark):
    ring = [(a + k, b + k) for k in (0, 10, 20) for a, b in itertools.combinations(range(5), 2)] + [(0, 10), (10, 20)]
    g = PropertyGraph.of(spark, sorted({x for e in ring for x in e}), ring)
    colour = dict(rows(g.call("graph_coloring.color_graph")))
    assert all(colour[a] != colour[b] for a, b in ring)
    for name, column in (("community_detection.get", "community_id"), ("leiden_community_detection.get", "community_id"), ("cugraph.louvain.get", "partition"), ("igraphalg.community_leiden", "community_id")):
        options = {"objective_function": "modularity"} if name.startswith("igraph") else {}
        label = dict(rows(g.call(name, **options), "node", column))
        assert {frozenset(n for n in label if label[n] == c) for c in set(label.values())} == {frozenset(range(k, k + 5)) for k in (0, 10, 20)}


def test_colours_are_bounded_and_greedy_orders_are_kept(spark):
    full = [(a, b, "R", {"weight": 1 if (a, b) == (0, 3) else 9}) for a, b in itertools.combinations(range(4), 2)]
    g = PropertyGraph.of(spark, [0, 1, 2, 3, 4], full)
    three = dict(rows(g.call("graph_coloring.color_graph", {"no_of_colors": 3})))
    assert set(three.values()) == {0, 1, 2} and sum(three[a] == three[b] for a, b, *_ in full) == 1
    assert set(dict(rows(g.call("graph_coloring.color_graph", {"no_of_colors": 1}))).values()) == {0}
    assert len(set(dict(rows(g.call("graph_coloring.color_graph"))).values())) == 4
    # Whichever is last has both colours beside it and takes that of the lighter edge, which the heaviest never is.
    triangle = PropertyGraph.of(spark, [0, 1, 2], [(0, 1, "R", {"weight": 5}), (1, 2, "R", {"weight": 3}), (0, 2, "R", {"weight": 1})])
    two = dict(rows(triangle.call("graph_coloring.color_graph", {"no_of_colors": 2})))
    assert two[0] != two[1] and set(two.values()) == {0, 1}
    star = [(0, i) for i in range(1, 6)]
    s = PropertyGraph.of(spark, list(range(6)), star)
    assert dict(rows(s.call("nxalg.greedy_color"))) == {0: 0, **{i: 1 for i in range(1, 6)}}
    loose = dict(rows(s.call("nxalg.greedy_color", "random_sequential")))
    assert all(loose[a] != loose[b] for a, b in star)
    for bad in ({"strategy": "DSATUR"}, {"interchange": True}):
        with pytest.raises(ValueError):
            s.call("nxalg.greedy_color", **bad)
    with pytest.raises(ValueError):
        s.call("graph_coloring.color_graph", {"no_of_colors": 0})
    with pytest.raises(ValueError):
        s.call("igraphalg.community_leiden", "modularity", initial_membership=[0] * 6)


def test_weighted_betweenness_against_all_paths(spark):
    draw = random.Random(5)
    n = 9
    edges = [(a, b, "R", {"w": draw.randint(1, 4)}) for a in range(n) for b in range(n) if draw.random() < 0.3]
    edges += [(*edges[0][:2], "R", {"w": 1}), (2, 2, "R", {"w": 1})]
    g = PropertyGraph.of(spark, list(range(n + 1)), edges)
    cost = {}
    for a, b, _, p in edges:
        if a != b:
            cost[a, b] = min(p["w"], cost.get((a, b), 99))

    def walks(path, length, end):
        if path[-1] == end:
            yield length, path
            return
        for y in range(n):
            if y not in path and (path[-1], y) in cost:
                yield from walks([*path, y], length + cost[path[-1], y], end)

    inner, ends = Counter(), Counter()
    for s, t in itertools.permutations(range(n), 2):
        found = list(walks([s], 0, t))
        best = [p for length, p in found if length == min(x for x, _ in found)]
        for p in best:
            for x in p[1:-1]:
                inner[x] += 1 / len(best)
        if best:
            ends[s] += 1
            ends[t] += 1
    got = dict(rows(g.call("nxalg.betweenness_centrality", weight="w", normalized=False)))
    assert got == pytest.approx({x: inner[x] for x in range(n + 1)})
    got = dict(rows(g.call("nxalg.betweenness_centrality", weight="w", endpoints=True)))
    assert got == pytest.approx({x: (inner[x] + ends[x]) / ((n + 1) * n) for x in range(n + 1)})
    plain = rows(g.call("nxalg.betweenness_centrality"))
    assert rows(g.call("nxalg.betweenness_centrality", weight="absent")) == [(x, pytest.approx(b)) for x, b in plain]
    zero = PropertyGraph.of(spark, [0, 1], [(0, 1, "R", {"w": 0})])
    with pytest.raises(ValueError):
        zero.call("nxalg.betweenness_centrality", weight="w")


def test_paths(people):
    g = people
    found = rows(g.call("path.expand", 0, ["HUNTS>", "CATCHES>"], [], 1, 2).select(F.col("result.nodes").alias("n")))
    assert found == [([0, 1],), ([0, 1, 2],)]
    assert rows(g.call("path.expand", 0, ["<FRIENDS>"], [], 1, 1).select("result.nodes", "result.rels")) == [([0, 3], [2])]
    assert rows(g.call("path.expand", 0, [], ["-Cat"], 0, 1).select(F.col("result.nodes"))) == [([0],), ([0, 3],), ([0, 3],)]
    assert rows(g.call("path.expand", 0, [">"], [">Mouse"], 0, 3).select(F.col("result.nodes"))) == [([0, 1, 2],), ([0, 3, 1, 2],)]
    assert rows(g.call("path.expand", 0, [">"], [">Mouse", "Dog", "Cat"], 0, 2).select(F.col("result.nodes"))) == [([0, 1, 2],)]
    assert rows(g.call("path.subgraph_nodes", 0, {"relationshipFilter": [">"], "maxHops": 1})) == [(0,), (1,), (3,)]
    path = g.call("path.create", 0, [0, 1, None, 2])
    p = path.select(g.call("path.elements", F.col("path")).alias("e")).first().e
    assert p == [0, 0, 1, 1, 2]
    assert path.select(g.call("path.slice", F.col("path"), 1, 1).alias("s")).first().s.nodes == [1, 2]
    both = path.select(g.call("path.combine", g.call("path.slice", F.col("path"), 0, 1), g.call("path.slice", F.col("path"), 1)).alias("c")).first().c
    assert both.nodes == [0, 1, 2]
    assert rows(g.call("algo.all_simple_paths", 0, 1, [">"], 3).select("path.nodes")) == [([0, 1],), ([0, 3, 1],)]
    assert rows(g.call("neighbors.at_hop", 0, [], 2)) == [(2,)]
    with pytest.raises(ValueError):
        g.call("neighbors.at_hop", 0, ["<HUNTS>"], 1)
    assert rows(g.call("neighbors.by_hop", 0, [], 3)) == [(1, [1, 3]), (2, [2]), (3, [])]


def test_topological_order_and_cycle(chain, people):
    assert chain.call("graph_util.topological_sort").first()[0] == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        people.call("graph_util.topological_sort")


def test_astar(spark):
    vs = [(0, ["City"], {"lat": 0, "lon": 0}), (1, ["City"], {"lat": 0, "lon": 1}), (2, ["City"], {"lat": 0, "lon": 2}), (3, ["Lone"], {})]
    g = PropertyGraph.of(spark, vs, [(0, 1, "R", {"distance": 2}), (1, 2, "R", {"distance": 2}), (0, 2, "R", {"distance": 7})])
    assert rows(g.call("algo.astar", 0, 2)) == [([0, 1, 2], 4.0)]
    assert rows(g.call("algo.astar", 0, 2, {"blacklisted_labels": ["Lone"], "unweighted": True})) == [([0, 2], 10.0)]
    assert rows(g.call("algo.astar", 0, 3)) == [([0], 0.0)]
    with pytest.raises(ValueError):
        g.call("algo.astar", 3, 0)


def test_distances_and_trees(spark):
    g = PropertyGraph.of(spark, list(range(5)), [(0, 1, "R", {"weight": 1}), (1, 2, "R", {"weight": 1}), (0, 2, "R", {"weight": 5}), (2, 3, "R", {"weight": 1})])
    assert rows(g.call("nxalg.shortest_path", 0, 3, "weight"), "path") == [([0, 1, 2, 3],)]
    assert rows(g.call("nxalg.all_shortest_paths", 0, 3), "paths") == [([0, 2, 3],)]
    assert g.call("igraphalg.shortest_path_length", 3, 0).first()[0] == math.inf
    assert rows(g.call("igraphalg.spanning_tree", "weight")) == [([0, 1],), ([1, 2],), ([2, 3],)]
    assert {r.center: r.cell for r in g.call("nxalg.voronoi_cells", [0, 3]).collect()} == {0: [0, 1, 2], 3: [3], None: [4]}
    assert g.call("max_flow.get_flow", 0, 3).first()[0] == 1.0
    assert sum(r.flow for r in g.call("max_flow.get_paths", 0, 2).collect()) == 6.0
    assert rows(g.call("nxalg.bfs_predecessors", 0)) == [(1, 0), (2, 0), (3, 2)]
    assert g.call("nxalg.dfs_preorder_nodes", 0).first()[0] == [0, 1, 2, 3]
    assert g.call("nxalg.lowest_common_ancestor", 2, 3).first()[0] == 2


def test_triads():
    pairs = [(a, b) for a in range(3) for b in range(3) if a != b]
    count = Counter(triad({p for i, p in enumerate(pairs) if m >> i & 1}) for m in range(64))
    assert set(count) == set(TRIADS) and count["003"] == count["300"] == 1 and count["030T"] == 6 and count["030C"] == 2 and count["120C"] == 6 and count["120D"] == count["120U"] == 3 and count["111D"] == count["111U"] == 6 and count["021D"] == count["021U"] == 3


def test_census_sums(spark):
    g = PropertyGraph.of(spark, list(range(8)), [(a, b) for _, a, b, _ in random_edges(3, 8, 15)])
    assert sum(r["count"] for r in g.call("nxalg.triadic_census").collect()) == 56


def test_combinatorial(spark):
    g = PropertyGraph.of(spark, [(0, ["Depot"], {"lat": 0, "lng": 0}), *[(i, ["Location"], {"lat": math.sin(i), "lng": math.cos(i)}) for i in range(1, 7)]], [])
    for method in ("greedy", "2_approx", "1.5_approx"):
        steps = dict(rows(g.call("tsp.solve", list(range(7)), method)))
        seen, x = [], 0
        for _ in range(7):
            seen.append(x)
            x = steps[x]
        assert x == 0 and sorted(seen) == list(range(7))
    routes = rows(g.call("vrp.route", 0, 2))
    assert sorted(b for _, b in routes if b) == list(range(1, 7)) and sum(a == 0 for a, _ in routes) == 2
    assert g.call("set_cover.cp_solve", [1, 2, 3, 4, 1, 2, 3, 4], [10, 10, 11, 11, 12, 13, 14, 15]).count() == 2
    chosen = {r[0] for r in g.call("set_cover.greedy", [1, 2, 3], [10, 10, 11]).collect()}
    assert chosen == {10, 11}
    with pytest.raises(ValueError):
        PropertyGraph.of(spark, [(0, [], {})], []).call("tsp.solve", [0])


def test_similarity(spark):
    g = PropertyGraph.of(spark, [0, 1, 2, 3], [(0, 2), (0, 3), (1, 3), (0, 3)])
    assert dict(((a, b), s) for a, b, s in rows(g.call("node_similarity.jaccard")))[(0, 1)] == 0.5
    assert len(rows(g.call("node_similarity.overlap"))) == 6
    with pytest.raises(ValueError):
        g.call("node_similarity.jaccard_pairwise", [0], [1, 2])
    v = PropertyGraph(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 0.0])], "id long, e array<double>"), spark.createDataFrame([], "id long, src long, dst long"))
    assert rows(v.call("knn.get", {"nodeProperties": "e"})) == [(0, 1, pytest.approx(0.8)), (1, 0, pytest.approx(0.8)), (2, 0, 0.0)]
    with pytest.raises(ValueError):
        v.call("knn.get", {"nodeProperties": "e", "topK": 0})


@pytest.mark.parametrize("few", [0, 1000])
def test_components_by_rounds_and_in_one_task(spark, few):
    from grafloom.plans.loops import components

    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)]
    nodes = list(range(42)) + list(range(100, 161))
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    g = PropertyGraph.of(spark, nodes, edges)
    assert {r.id: r.component for r in components(g.V, g.E, few=few).collect()} == label
    if not few:
        with pytest.raises(RuntimeError):
            components(g.V, g.E, max_rounds=1, few=0)
