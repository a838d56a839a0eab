"""Queries over graphs and lists derived from the driver's tables, with the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph as G
from .functions import collections as C
from .functions import dates, documents, maps, text
from .registry import load_all

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The derived graphs in SQL: views V (id, ...) and E (src, dst, weight).
TRADE = """E AS (SELECT l_suppkey::BIGINT AS src, l_partkey::BIGINT + 1000000000 AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
V AS (SELECT s_suppkey::BIGINT AS id FROM supplier UNION ALL SELECT p_partkey::BIGINT + 1000000000 FROM part)"""
BOTH = """E0 AS (SELECT l_suppkey::BIGINT AS src, l_partkey::BIGINT + 1000000000 AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
E AS (SELECT * FROM E0 UNION ALL SELECT dst, src, weight FROM E0),
V AS (SELECT s_suppkey::BIGINT AS id FROM supplier UNION ALL SELECT p_partkey::BIGINT + 1000000000 FROM part)"""
GEO = """E AS (SELECT n_nationkey::BIGINT + 100 AS src, n_regionkey::BIGINT AS dst, 'IN_REGION' AS type FROM nation
UNION ALL SELECT s_suppkey::BIGINT + 1000000000, s_nationkey::BIGINT + 100, 'IN_NATION' FROM supplier UNION ALL SELECT c_custkey::BIGINT + 2000000000, c_nationkey::BIGINT + 100, 'IN_NATION' FROM customer),
V AS (SELECT r_regionkey::BIGINT AS id, 'Region' AS label FROM region UNION ALL SELECT n_nationkey::BIGINT + 100, 'Nation' FROM nation
UNION ALL SELECT s_suppkey::BIGINT + 1000000000, 'Supplier' FROM supplier UNION ALL SELECT c_custkey::BIGINT + 2000000000, 'Customer' FROM customer)"""
NATIONS = """E AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
V AS (SELECT n_nationkey::BIGINT AS id FROM nation)"""

Graph = Callable[[SparkSession, str], G.PropertyGraph]
trade: Graph = G.trade
both: Graph = lambda s, d: G.trade(s, d, True)
geo: Graph = G.geography
nations: Graph = G.nations
flow: Graph = G.flow


def add(name: str, graph: Graph, run: Callable[[G.PropertyGraph], DataFrame], views: str = "", sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: run(graph(spark, d))
    if sql:
        SQL[name] = f"WITH RECURSIVE {views}{', ' if not sql.startswith('SELECT') else ' '}{sql}"


def _r(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


load_all()

# ---- degrees and ranks ---------------------------------------------------------------

_DEG = "D AS (SELECT id, count(E.{key}) AS d FROM V LEFT JOIN E ON V.id = E.{key} GROUP BY id)"
add("degree_centrality_get", trade, lambda g: _r(g.call("degree_centrality.get"), "degree"), TRADE,
    "B AS (SELECT src AS id FROM E UNION ALL SELECT dst FROM E), D AS (SELECT V.id, count(B.id) AS d FROM V LEFT JOIN B USING (id) GROUP BY V.id) SELECT id AS node, round(d / (SELECT count(*) - 1.0 FROM V)::DOUBLE, 9) AS degree FROM D")
for _kind, _key in (("out", "src"), ("in", "dst")):
    add(f"degree_centrality_{_kind}", trade, lambda g, k=_kind: _r(g.call("degree_centrality.get", type=k), "degree"), TRADE, f"{_DEG.format(key=_key)} SELECT id AS node, round(d / (SELECT count(*) - 1.0 FROM V)::DOUBLE, 9) AS degree FROM D")
    add(f"node_degree_{_kind}", geo, lambda g, k=_kind: g.call(f"node.degree_{k}"), GEO, f"{_DEG.format(key=_key)} SELECT id AS node, d AS degree FROM D")
add("degree_centrality_get_subgraph", geo, lambda g: _r(g.call("degree_centrality.get_subgraph", g.V.filter(~F.array_contains("labels", "Customer")).select("id"), None), "degree"), GEO,
    "W AS (SELECT id FROM V WHERE label <> 'Customer'), F AS (SELECT E.* FROM E WHERE src IN (SELECT id FROM W) AND dst IN (SELECT id FROM W)), B AS (SELECT src AS id FROM F UNION ALL SELECT dst FROM F), "
    "D AS (SELECT W.id, count(B.id) AS d FROM W LEFT JOIN B USING (id) GROUP BY W.id) SELECT id AS node, round(d / (SELECT count(*) - 1.0 FROM W)::DOUBLE, 9) AS degree FROM D")  # fmt: skip


def _pagerank_sql(views: str, rounds: int, weight: str, dangling: bool, restart: str, final: str) -> str:
    parts = [f"S AS MATERIALIZED (SELECT src, dst, sum({weight}) / any_value(t) AS share FROM E JOIN (SELECT src, sum({weight}) AS t FROM E GROUP BY src) USING (src) GROUP BY src, dst)", "N AS (SELECT count(*)::DOUBLE AS n FROM V)", f"P AS MATERIALIZED ({restart})", "R0 AS MATERIALIZED (SELECT id, p, 1 / n AS r FROM P, N)"]
    for i in range(rounds):
        lost = f"(SELECT coalesce(sum(r), 0) FROM R{i} WHERE id NOT IN (SELECT src FROM S))" if dangling else "0"
        parts.append(f"R{i + 1} AS MATERIALIZED (SELECT P.id, P.p, 0.15 * P.p + 0.85 * (coalesce(x, 0) + {lost} * P.p) AS r FROM P LEFT JOIN (SELECT dst, sum(r * share) AS x FROM S JOIN R{i} ON src = id GROUP BY dst) ON dst = P.id)")
    return f"WITH {views}, {', '.join(parts)} {final.format(last=f'R{rounds}')}"


_UNIFORM = "SELECT id, 1 / n AS p FROM V, N"
add("pagerank_get", both, lambda g: _r(g.call("pagerank.get", max_iterations=10, stop_epsilon=0.0), "rank", places=10))
SQL["pagerank_get"] = _pagerank_sql(BOTH, 10, "1", False, _UNIFORM, "SELECT id AS node, round(r / (SELECT sum(r) FROM {last}), 10) AS rank FROM {last}")
add("nxalg_pagerank", trade, lambda g: _r(g.call("nxalg.pagerank", max_iter=8, tol=0.0), "rank", places=10))
SQL["nxalg_pagerank"] = _pagerank_sql(TRADE, 8, "weight", True, _UNIFORM, "SELECT id AS node, round(r, 10) AS rank FROM {last}")
add("cugraph_pagerank_get", nations, lambda g: _r(g.call("cugraph.pagerank.get", max_iterations=12, stop_epsilon=0.0), "pagerank", places=10))
SQL["cugraph_pagerank_get"] = _pagerank_sql(NATIONS, 12, "1", True, _UNIFORM, "SELECT id AS node, round(r, 10) AS pagerank FROM {last}")
add("cugraph_personalized_pagerank_get", nations, lambda g: _r(g.call("cugraph.personalized_pagerank.get", [1, 5], [1.0, 3.0], max_iterations=12, stop_epsilon=0.0), "pagerank", places=10))
SQL["cugraph_personalized_pagerank_get"] = _pagerank_sql(NATIONS, 12, "weight", True, "SELECT id, CASE id WHEN 1 THEN 0.25 WHEN 5 THEN 0.75 ELSE 0.0 END AS p FROM V", "SELECT id AS node, round(r, 10) AS pagerank FROM {last}")


def _unrolled(views: str, first: str, step: str, rounds: int, final: str, extra: str = "") -> str:
    parts = [f"X0 AS MATERIALIZED ({first})", *(f"X{i + 1} AS MATERIALIZED ({step.replace('@', f'X{i}')})" for i in range(rounds))]
    return f"WITH {views}, {extra}{', '.join(parts)} {final.replace('@', f'X{rounds}')}"


add("cugraph_katz_centrality_get", nations, lambda g: _r(g.call("cugraph.katz_centrality.get", alpha=0.01, max_iterations=8, epsilon=0.0), "katz_centrality"))
SQL["cugraph_katz_centrality_get"] = _unrolled(NATIONS, "SELECT id, 0.0::DOUBLE AS x FROM V", "SELECT V.id, 0.01 * coalesce(s, 0) + 1 AS x FROM V LEFT JOIN (SELECT dst, sum(x) AS s FROM E JOIN @ ON src = id GROUP BY dst) ON dst = V.id", 8, "SELECT id AS node, round(x, 9) AS katz_centrality FROM @")
add("cugraph_hits_get", nations, lambda g: _r(g.call("cugraph.hits.get", max_iterations=6, tolerance=0.0), "hubs", "authorities"))
SQL["cugraph_hits_get"] = _unrolled(
    NATIONS, "SELECT id, 1.0 / (SELECT count(*) FROM V) AS h, 0.0::DOUBLE AS a FROM V",
    "SELECT V.id, coalesce(y.h, 0) / (SELECT sum(z) FROM (SELECT sum(a2) AS z FROM E JOIN (SELECT dst AS d2, sum(h) / (SELECT sum(h) FROM E JOIN @ ON src = id) AS a2 FROM E JOIN @ ON src = id GROUP BY dst) ON dst = d2 GROUP BY src)) AS h, coalesce(w.a, 0) AS a FROM V "
    "LEFT JOIN (SELECT dst, sum(h) / (SELECT sum(h) FROM E JOIN @ ON src = id) AS a FROM E JOIN @ ON src = id GROUP BY dst) w ON w.dst = V.id "
    "LEFT JOIN (SELECT src, sum(a3) AS h FROM E JOIN (SELECT dst AS d3, sum(h) / (SELECT sum(h) FROM E JOIN @ ON src = id) AS a3 FROM E JOIN @ ON src = id GROUP BY dst) ON dst = d3 GROUP BY src) y ON y.src = V.id",
    6, "SELECT id AS node, round(h, 9) AS hubs, round(a, 9) AS authorities FROM @",
)
for _n, _call in (("betweenness_centrality_get", "betweenness_centrality.get"), ("nxalg_betweenness_centrality", "nxalg.betweenness_centrality")):
    add(_n, nations, lambda g, n=_call: _r(g.call(n), "betweenness" if n.startswith("nx") else "betweenness_centrality"))
# Unweighted shortest paths of at most two steps, as on any graph whose pairs are that near.
_BC = """P AS (SELECT a.id AS s, b.id AS t FROM V a, V b WHERE a.id <> b.id AND NOT EXISTS (SELECT 1 FROM E WHERE src = a.id AND dst = b.id)),
M AS (SELECT s, t, x.dst AS v FROM P JOIN E x ON x.src = s JOIN E y ON y.src = x.dst AND y.dst = t WHERE x.dst <> s AND x.dst <> t),
C AS (SELECT s, t, count(*) AS n FROM M GROUP BY s, t), S AS (SELECT v, sum(1.0 / n) AS b FROM M JOIN C USING (s, t) GROUP BY v)
SELECT id AS node, round(coalesce(b, 0) / ((SELECT count(*) FROM V) - 1) / ((SELECT count(*) FROM V) - 2), 9) AS {name} FROM V LEFT JOIN S ON v = id"""
SQL["betweenness_centrality_get"] = f"WITH {NATIONS}, {_BC.format(name='betweenness_centrality')}"
SQL["nxalg_betweenness_centrality"] = f"WITH {NATIONS}, {_BC.format(name='betweenness')}"

# ---- structure -------------------------------------------------------------------------

_ROOT = "R AS (SELECT V.id, CASE label WHEN 'Region' THEN id WHEN 'Nation' THEN (SELECT min(dst) FROM E WHERE src = V.id) ELSE (SELECT min(b.dst) FROM E a JOIN E b ON b.src = a.dst WHERE a.src = V.id) END AS root FROM V)"
add("weakly_connected_components_get", geo, lambda g: g.call("weakly_connected_components.get"), GEO, f"{_ROOT} SELECT id AS node, root AS component_id FROM R")
add("bridges_get", geo, lambda g: g.call("bridges.get"), GEO, "SELECT src AS node_from, dst AS node_to FROM E")
add("biconnected_components_get", geo, lambda g: g.call("biconnected_components.get").groupBy("bcc_id").agg(F.min("node_from").alias("node_from"), F.min("node_to").alias("node_to"), F.count(F.lit(1)).alias("n")).drop("bcc_id"), GEO, "SELECT src AS node_from, dst AS node_to, 1 AS n FROM E")
add("nxalg_bridges", geo, lambda g: g.call("nxalg.bridges", root=1).select(F.get("bridges", F.lit(0)).alias("a"), F.get("bridges", F.lit(1)).alias("b")), GEO, f"{_ROOT} SELECT src AS a, dst AS b FROM E JOIN R ON R.id = src WHERE root = 1")
add("nxalg_is_bipartite", trade, lambda g: g.call("nxalg.is_bipartite"), TRADE, "SELECT true AS is_bipartite")
add("nxalg_core_number", geo, lambda g: g.call("nxalg.core_number"), GEO, "SELECT id AS node, (id IN (SELECT src FROM E UNION SELECT dst FROM E))::BIGINT AS core FROM V")
add("nxalg_biconnected_components", geo, lambda g: g.call("nxalg.biconnected_components").select(F.array_min("components").alias("a"), F.array_max("components").alias("b")), GEO, "SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM E")
add("nxalg_check_planarity", geo, lambda g: g.call("nxalg.check_planarity"), GEO, "SELECT true AS is_planar")
add("nxalg_is_forest", geo, lambda g: g.call("nxalg.is_forest"), GEO, "SELECT true AS is_forest")
add("nxalg_is_tree", geo, lambda g: g.call("nxalg.is_tree"), GEO, "SELECT false AS is_tree")
add("nxalg_is_branching", geo, lambda g: g.call("nxalg.is_branching"), GEO, "SELECT coalesce((SELECT max(n) <= 1 FROM (SELECT count(*) AS n FROM E GROUP BY dst)), true) AS is_branching")
add("nxalg_is_arborescence", geo, lambda g: g.call("nxalg.is_arborescence"), GEO, "SELECT false AS is_arborescence")
add("nxalg_is_eulerian", nations, lambda g: g.call("nxalg.is_eulerian"), NATIONS, "SELECT (SELECT count(*) FROM V WHERE (SELECT count(*) FROM E WHERE src = id) <> (SELECT count(*) FROM E WHERE dst = id)) = 0 AND (SELECT count(*) FROM V WHERE id NOT IN (SELECT src FROM E UNION SELECT dst FROM E)) = 0 AS is_eulerian")
add("nxalg_has_eulerian_path", geo, lambda g: g.call("nxalg.has_eulerian_path"), GEO, "SELECT false AS has_eulerian_path")
add("nxalg_flow_hierarchy", geo, lambda g: g.call("nxalg.flow_hierarchy"), GEO, "SELECT 1.0::DOUBLE AS flow_hierarchy")
add("nxalg_isolates", trade, lambda g: g.call("nxalg.isolates"), TRADE, "SELECT id AS isolates FROM V WHERE id NOT IN (SELECT src FROM E UNION SELECT dst FROM E)")
add("nxalg_is_isolate", trade, lambda g: g.call("nxalg.is_isolate", 1), TRADE, "SELECT 1 NOT IN (SELECT src FROM E) AS is_isolate")
add("nxalg_is_tournament", nations, lambda g: g.call("nxalg.is_tournament"), NATIONS, "P AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS k FROM E GROUP BY 1, 2) SELECT (SELECT count(*) FROM P) = (SELECT count(*) * (count(*) - 1) / 2 FROM V) AND (SELECT max(k) FROM P) = 1 AS is_tournament")
add("nxalg_reciprocity", nations, lambda g: _r(g.call("nxalg.reciprocity"), "reciprocity").select("reciprocity"), NATIONS, "SELECT round(count(*) FILTER (EXISTS (SELECT 1 FROM E b WHERE b.src = a.dst AND b.dst = a.src)) / count(*), 9) AS reciprocity FROM E a")
SQL["nxalg_reciprocity"] = f"WITH {NATIONS} SELECT round((SELECT count(*) FROM E a JOIN E b ON b.src = a.dst AND b.dst = a.src) / (SELECT count(*) FROM E), 9) AS reciprocity"
add("nxalg_degree_assortativity_coefficient", trade, lambda g: _r(g.call("nxalg.degree_assortativity_coefficient"), "assortativity", places=6), TRADE, "O AS (SELECT src, count(*) AS o FROM E GROUP BY src), I AS (SELECT dst, count(*) AS i FROM E GROUP BY dst) SELECT round(corr(o, i), 6) AS assortativity FROM E JOIN O USING (src) JOIN I USING (dst)")
add("nxalg_clustering", nations, lambda g: _r(g.call("nxalg.clustering"), "clustering"), NATIONS,
    "M AS (SELECT src, dst, count(*) AS m FROM (SELECT src, dst FROM E UNION ALL SELECT dst, src FROM E) GROUP BY src, dst), T AS (SELECT a.src AS v, sum(a.m * b.m * c.m) AS t FROM M a JOIN M b ON a.src = b.src JOIN M c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src), "
    "D AS (SELECT src AS v, sum(m) AS d, count(*) FILTER (m = 2) AS r FROM M GROUP BY src) SELECT id AS node, round(CASE WHEN coalesce(2 * (d * (d - 1) - 2 * r), 0) = 0 THEN 0 ELSE coalesce(t, 0) / (2 * (d * (d - 1) - 2 * r)) END, 9) AS clustering FROM V LEFT JOIN D ON D.v = id LEFT JOIN T ON T.v = id")  # fmt: skip
add("nxalg_node_boundary", nations, lambda g: g.call("nxalg.node_boundary", [0, 1, 2]), NATIONS, "SELECT DISTINCT dst AS boundary FROM E WHERE src IN (0, 1, 2) AND dst NOT IN (0, 1, 2)")
add("nxalg_node_expansion", nations, lambda g: _r(g.call("nxalg.node_expansion", [0, 1, 2]), "node_expansion"), NATIONS, "SELECT round((SELECT count(DISTINCT dst) FROM E WHERE src IN (0, 1, 2) AND dst NOT IN (0, 1, 2)) / 3, 9) AS node_expansion")
add("nxalg_is_edge_cover", geo, lambda g: g.call("nxalg.is_edge_cover", g.E.select("id")), GEO, "SELECT (SELECT count(*) FROM V WHERE id NOT IN (SELECT src FROM E UNION SELECT dst FROM E)) = 0 AS is_edge_cover")
add("nxalg_is_isomorphic", nations, lambda g: g.call("nxalg.is_isomorphic", [0, 1, 2, 3], None, [0, 1, 2, 3], None), NATIONS, "SELECT true AS is_isomorphic")
add("nxalg_weakly_connected_components_subgraph", geo, lambda g: g.call("nxalg.weakly_connected_components_subgraph", g.V.filter("id < 1000").select("id"), None).select("n_components"), GEO, "SELECT (SELECT count(*) FROM region) AS n_components")

# ---- distances and paths ------------------------------------------------------------

_STEPS = "W(s, t, d) AS (SELECT id, id, 0 FROM V UNION SELECT s, dst, d + 1 FROM W JOIN {e} ON src = t WHERE d < 8)"
_DIST = f"{_STEPS.format(e='E')}, D AS (SELECT s, t, min(d) AS d FROM W GROUP BY s, t)"
add("nxalg_shortest_path_length", nations, lambda g: g.call("nxalg.shortest_path_length", source=0), NATIONS, f"{_DIST} SELECT s AS source, t AS target, d::DOUBLE AS length FROM D WHERE s = 0")
add("nxalg_shortest_path", nations, lambda g: g.call("nxalg.shortest_path", source=0).select("target", F.size("path").alias("n")), NATIONS, f"{_DIST} SELECT t AS target, (d + 1)::INT AS n FROM D WHERE s = 0")
add("igraphalg_shortest_path_length", nations, lambda g: g.call("igraphalg.shortest_path_length", 0, 7), NATIONS, f"{_DIST} SELECT coalesce((SELECT d::DOUBLE FROM D WHERE s = 0 AND t = 7), 'inf'::DOUBLE) AS length")
add("igraphalg_get_shortest_path", nations, lambda g: g.call("igraphalg.get_shortest_path", 0, 7).select(F.size("path").alias("n")), NATIONS, f"{_DIST} SELECT (d + 1)::INT AS n FROM D WHERE s = 0 AND t = 7")
add("igraphalg_all_shortest_path_lengths", nations, lambda g: g.call("igraphalg.all_shortest_path_lengths", directed=True), NATIONS, f"{_DIST} SELECT a.id AS src_node, b.id AS dest_node, coalesce(d::DOUBLE, 'inf'::DOUBLE) AS length FROM V a CROSS JOIN V b LEFT JOIN D ON s = a.id AND t = b.id")
add("nxalg_diameter", nations, lambda g: g.call("nxalg.diameter"), NATIONS, f"{_DIST} SELECT max(d)::BIGINT AS diameter FROM D")
add("nxalg_center", nations, lambda g: g.call("nxalg.center"), NATIONS, f"{_DIST}, X AS (SELECT s, max(d) AS e FROM D GROUP BY s) SELECT s AS center FROM X WHERE e = (SELECT min(e) FROM X)")
add("nxalg_wiener_index", nations, lambda g: g.call("nxalg.wiener_index"), NATIONS, f"{_DIST} SELECT CASE WHEN count(*) < (SELECT count(*) * count(*) FROM V) THEN 'inf'::DOUBLE ELSE sum(d)::DOUBLE END AS wiener_index FROM D")
add("nxalg_global_efficiency", nations, lambda g: _r(g.call("nxalg.global_efficiency"), "global_efficiency"), NATIONS.replace("V AS", "E1 AS (SELECT src, dst FROM E UNION SELECT dst, src FROM E), V AS"), f"{_DIST.replace('JOIN E ', 'JOIN E1 ')} SELECT round(sum(CASE WHEN d > 0 THEN 1.0 / d ELSE 0 END) / ((SELECT count(*) FROM V) * ((SELECT count(*) FROM V) - 1)), 9) AS global_efficiency FROM D")
add("nxalg_has_path", geo, lambda g: g.call("nxalg.has_path", G.CUSTOMER + 1, 0), GEO, f"{_ROOT} SELECT root = 0 AS has_path FROM R WHERE id = 2000000001")
add("nxalg_all_shortest_paths", nations, lambda g: g.call("nxalg.all_shortest_paths", 0, 7).agg(F.count(F.lit(1)).alias("n")), NATIONS, "SELECT CASE WHEN EXISTS (SELECT 1 FROM E WHERE src = 0 AND dst = 7) THEN 1 ELSE (SELECT count(*) FROM E x JOIN E y ON y.src = x.dst WHERE x.src = 0 AND y.dst = 7) END AS n")
add("nxalg_all_simple_paths", nations, lambda g: g.call("nxalg.all_simple_paths", 0, 7, 2).agg(F.count(F.lit(1)).alias("n")), NATIONS, "SELECT (SELECT count(*) FROM E WHERE src = 0 AND dst = 7) + (SELECT count(*) FROM E x JOIN E y ON y.src = x.dst WHERE x.src = 0 AND y.dst = 7 AND x.dst NOT IN (0, 7)) AS n")
add("algo_all_simple_paths", nations, lambda g: g.call("algo.all_simple_paths", 0, 7, [">"], 2).agg(F.count(F.lit(1)).alias("n")), NATIONS, "SELECT (SELECT count(*) FROM E WHERE src = 0 AND dst = 7) + (SELECT count(*) FROM E x JOIN E y ON y.src = x.dst WHERE x.src = 0 AND y.dst = 7 AND x.dst NOT IN (0, 7)) AS n")
add("igraphalg_get_all_simple_paths", nations, lambda g: g.call("igraphalg.get_all_simple_paths", 0, 7, 1).agg(F.count(F.lit(1)).alias("n")), NATIONS, "SELECT count(*) AS n FROM E WHERE src = 0 AND dst = 7")
add("nxalg_is_simple_path", nations, lambda g: g.call("nxalg.is_simple_path", [0, 1, 2]), NATIONS, "SELECT EXISTS (SELECT 1 FROM E WHERE src = 0 AND dst = 1) AND EXISTS (SELECT 1 FROM E WHERE src = 1 AND dst = 2) AS is_simple_path")
add("nxalg_multi_source_dijkstra_path_length", geo, lambda g: g.call("nxalg.multi_source_dijkstra_path_length", [100, 101]), GEO, "SELECT id AS target, (id < 100)::INT::DOUBLE AS length FROM V WHERE id IN (100, 101) OR id IN (SELECT dst FROM E WHERE src IN (100, 101))")
add("nxalg_multi_source_dijkstra_path", geo, lambda g: g.call("nxalg.multi_source_dijkstra_path", [100, 101]).select("target", F.size("path").alias("n")), GEO, "SELECT id AS target, (1 + (id < 100)::INT)::INT AS n FROM V WHERE id IN (100, 101) OR id IN (SELECT dst FROM E WHERE src IN (100, 101))")
add("algo_astar", nations, lambda g: g.call("algo.astar", 0, 7, {"unweighted": True, "relationships_filter": [">"]}).select("weight"), NATIONS, f"{_DIST} SELECT 10.0 * d::DOUBLE AS weight FROM D WHERE s = 0 AND t = 7")
add("algo_cover", geo, lambda g: g.E.join(g.call("algo.cover", g.V.filter("id < 1000").select("id")).withColumnRenamed("rel", "id"), "id").select("src", "dst"), GEO, "SELECT src, dst FROM E WHERE src < 1000 AND dst < 1000")
add("graph_util_connect_nodes", nations, lambda g: g.call("graph_util.connect_nodes", [0, 1, 2, 3]).agg(F.count(F.lit(1)).alias("n")), NATIONS, "SELECT count(*) AS n FROM E WHERE src < 4 AND dst < 4")
add("neighbors_at_hop", geo, lambda g: g.call("neighbors.at_hop", 0, ["<IN_REGION", "<IN_NATION"], 2), GEO, "SELECT a.src AS nodes FROM E a JOIN E b ON a.dst = b.src WHERE b.dst = 0")
add("neighbors_by_hop", geo, lambda g: g.call("neighbors.by_hop", 0, ["<IN_REGION", "<IN_NATION"], 3).select("depth", F.size("nodes").alias("n")), GEO, "SELECT 1 AS depth, count(*)::INT AS n FROM E WHERE dst = 0 UNION ALL SELECT 2, count(*) FROM E a JOIN E b ON a.dst = b.src WHERE b.dst = 0 UNION ALL SELECT 3, 0")
SQL["neighbors_by_hop"] = f"WITH {GEO} SELECT 1::INT AS depth, count(*)::INT AS n FROM E WHERE dst = 0 UNION ALL SELECT 2, count(*) FROM E a JOIN E b ON a.dst = b.src WHERE b.dst = 0 UNION ALL SELECT 3, 0"
add("graph_util_descendants", geo, lambda g: g.call("graph_util.descendants", G.CUSTOMER + 1), GEO, "SELECT dst AS descendants FROM E WHERE src = 2000000001 UNION SELECT b.dst FROM E a JOIN E b ON a.dst = b.src WHERE a.src = 2000000001")
add("graph_util_ancestors", geo, lambda g: g.call("graph_util.ancestors", 1), GEO, f"{_ROOT} SELECT id AS ancestors FROM R WHERE root = 1 AND id <> 1")
add("nxalg_ancestors", geo, lambda g: g.call("nxalg.ancestors", 1), GEO, f"{_ROOT} SELECT id AS ancestors FROM R WHERE root = 1 AND id <> 1")
add("nxalg_descendants", geo, lambda g: g.call("nxalg.descendants", 105), GEO, "SELECT dst AS descendants FROM E WHERE src = 105")
add("nxalg_lowest_common_ancestor", geo, lambda g: g.call("nxalg.lowest_common_ancestor", 0, 0), GEO, "SELECT 0::BIGINT AS ancestor")
add("path_expand", geo, lambda g: g.call("path.expand", 0, ["<"], [], 1, 2).select(F.element_at("result.nodes", -1).alias("last"), F.size("result.rels").alias("n")), GEO, "SELECT src AS last, 1 AS n FROM E WHERE dst = 0 UNION ALL SELECT a.src, 2 FROM E a JOIN E b ON a.dst = b.src WHERE b.dst = 0")
add("path_subgraph_nodes", geo, lambda g: g.call("path.subgraph_nodes", 0, {"labelFilter": ["-Customer"], "relationshipFilter": ["<"]}), GEO, f"{_ROOT} SELECT R.id AS nodes FROM R JOIN V USING (id) WHERE root = 0 AND label <> 'Customer'")
add("path_subgraph_all", geo, lambda g: g.call("path.subgraph_all", 0, {"labelFilter": ["-Customer"], "relationshipFilter": ["<"]}).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), GEO, f"{_ROOT}, S AS (SELECT R.id FROM R JOIN V USING (id) WHERE root = 0 AND label <> 'Customer') SELECT 'node' AS kind, count(*) AS n FROM S UNION ALL SELECT 'rel', count(*) FROM E WHERE src IN (SELECT id FROM S) AND dst IN (SELECT id FROM S)")
for _n in ("bfs_tree", "dfs_tree"):
    add(f"nxalg_{_n}", nations, lambda g, n=_n: g.call(f"nxalg.{n}", 0).select(F.explode("tree").alias("x")).agg(F.count(F.lit(1)).alias("n")), NATIONS, f"{_DIST} SELECT count(*) AS n FROM D WHERE s = 0")
add("nxalg_minimum_spanning_tree", nations, lambda g: g.call("nxalg.minimum_spanning_tree").select(F.size("nodes").alias("nodes"), F.size("edges").alias("edges")), NATIONS, "SELECT count(*)::INT AS nodes, (count(*) - 1)::INT AS edges FROM V")
add("igraphalg_spanning_tree", geo, lambda g: g.call("igraphalg.spanning_tree").select(F.get("tree", F.lit(0)).alias("a"), F.get("tree", F.lit(1)).alias("b")), GEO, "SELECT src AS a, dst AS b FROM E")
add("union_find_connected", geo, lambda g: g.call("union_find.connected", [G.CUSTOMER + 1, 100], [G.SUPPLIER + 1, 0]), GEO, f"{_ROOT} SELECT a.id AS node1, b.id AS node2, a.root = b.root AS connected FROM R a, R b WHERE (a.id = 2000000001 AND b.id = 1000000001) OR (a.id = 100 AND b.id = 0)")

# ---- similarity, neighbours, communities ----------------------------------------------

_PAIRS = "L AS (SELECT DISTINCT src, dst FROM E), Z AS (SELECT src, count(*) AS z FROM L GROUP BY src), C AS (SELECT a.src AS x, b.src AS y, count(*) AS c FROM L a JOIN L b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2)"
add("node_similarity_jaccard", nations, lambda g: _r(g.call("node_similarity.jaccard"), "similarity"), NATIONS, f"{_PAIRS} SELECT a.id AS node1, b.id AS node2, round(CASE WHEN coalesce(p.z, 0) + coalesce(q.z, 0) - coalesce(c, 0) = 0 THEN 0 ELSE coalesce(c, 0) / (coalesce(p.z, 0) + coalesce(q.z, 0) - coalesce(c, 0)) END, 9) AS similarity FROM V a JOIN V b ON a.id < b.id LEFT JOIN C ON x = a.id AND y = b.id LEFT JOIN Z p ON p.src = a.id LEFT JOIN Z q ON q.src = b.id")
add("node_similarity_overlap", trade, lambda g: _r(g.call("node_similarity.overlap", zeros=False), "similarity"), TRADE, f"{_PAIRS} SELECT x AS node1, y AS node2, round(c / least(p.z, q.z), 9) AS similarity FROM C JOIN Z p ON p.src = x JOIN Z q ON q.src = y")
for _n, _f in (("jaccard", "c / (p.z + q.z - c)"), ("overlap", "c / least(p.z, q.z)")):
    add(f"node_similarity_{_n}_pairwise", nations, lambda g, n=_n: _r(g.call(f"node_similarity.{n}_pairwise", [0, 1, 2], [3, 4, 5]), "similarity"), NATIONS, f"{_PAIRS} SELECT x AS node1, y AS node2, round({_f}, 9) AS similarity FROM C JOIN Z p ON p.src = x JOIN Z q ON q.src = y WHERE (x, y) IN ((0, 3), (1, 4), (2, 5))")


def vectors(spark: SparkSession, d: str) -> G.PropertyGraph:
    e = G.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return G.PropertyGraph(e, spark.createDataFrame([], G.E_SCHEMA))


_VEC = "V AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
add("node_similarity_cosine_pairwise", vectors, lambda g: _r(g.call("node_similarity.cosine_pairwise", "embedding", [0, 1], [2, 3]), "similarity"), _VEC, "SELECT a.id AS node1, b.id AS node2, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM V a, V b WHERE (a.id, b.id) IN ((0, 2), (1, 3))")
add("node_similarity_cosine", vectors, lambda g: g.call("node_similarity.cosine", "embedding").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("similarity"), 3).alias("total")), _VEC, "SELECT count(*) AS n, round(sum(list_cosine_similarity(a.v, b.v)), 3) AS total FROM V a JOIN V b ON a.id < b.id")
add("knn_get", vectors, lambda g: _r(g.call("knn.get", {"nodeProperties": ["embedding"], "topK": 3}), "similarity"), _VEC, "S AS (SELECT a.id AS node, b.id AS neighbour, (list_cosine_similarity(a.v, b.v) + 1) / 2 AS s FROM V a JOIN V b ON a.id <> b.id) SELECT node, neighbour, round(s, 9) AS similarity FROM S QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(s, 12) DESC, neighbour) <= 3")
add("kmeans_get_clusters", vectors, lambda g: g.call("kmeans.get_clusters", 5).agg(F.count(F.lit(1)).alias("n")), _VEC, "SELECT count(*) AS n FROM V")
add("nxalg_jaccard_coefficient", geo, lambda g: _r(g.call("nxalg.jaccard_coefficient", [(100, 101), (0, 1)]), "coef"))
SQL["nxalg_jaccard_coefficient"] = f"""WITH {GEO}, L AS (SELECT src, dst FROM E UNION SELECT dst, src FROM E), P(u, v) AS (VALUES (100::BIGINT, 101::BIGINT), (0, 1))
SELECT u, v, round(coalesce((SELECT count(*) FROM L a JOIN L b ON a.dst = b.dst WHERE a.src = u AND b.src = v)::DOUBLE / nullif((SELECT count(DISTINCT dst) FROM L WHERE src IN (u, v)), 0), 0), 9) AS coef FROM P"""
add("graph_coloring_conflicts", nations, lambda g: (lambda c: g.E.join(c.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").filter("a = b").agg(F.count(F.lit(1)).alias("conflicts")))(g.call("graph_coloring.color_graph")), NATIONS, "SELECT 0 AS conflicts")
add("cugraph_generator_rmat", nations, lambda g: g.call("cugraph.generator.rmat", scale=10, num_edges=5000).agg(F.count(F.lit(1)).alias("n"), (F.max(F.greatest("source", "target")) < 1024).alias("within")), NATIONS, "SELECT 5000 AS n, true AS within")

# ---- nodes, metadata, edits ------------------------------------------------------------

add("node_relationship_exists", geo, lambda g: g.call("node.relationship_exists", 100, ["IN_REGION>"]), GEO, "SELECT EXISTS (SELECT 1 FROM E WHERE src = 100 AND type = 'IN_REGION') AS exists")
add("nodes_relationships_exist", geo, lambda g: g.call("nodes.relationships_exist", [0, 100], ["IN_REGION>", "<IN_NATION"]).select("node", F.col("result")["IN_REGION>"].alias("a"), F.col("result")["<IN_NATION"].alias("b")), GEO, "SELECT id AS node, EXISTS (SELECT 1 FROM E WHERE src = id AND type = 'IN_REGION') AS a, EXISTS (SELECT 1 FROM E WHERE dst = id AND type = 'IN_NATION') AS b FROM V WHERE id IN (0, 100)")
add("node_relationships_exist", geo, lambda g: g.call("node.relationships_exist", 100, ["IN_REGION>"]).select(F.col("result")["IN_REGION>"].alias("a")), GEO, "SELECT true AS a")
add("nodes_relationship_types", geo, lambda g: g.call("nodes.relationship_types", g.V.select("id")).select("node", F.array_join("types", ",").alias("types")), GEO, "SELECT id AS node, coalesce((SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM E WHERE src = id OR dst = id), '') AS types FROM V")
SQL["nodes_relationship_types"] = f"WITH {GEO}, B AS (SELECT src AS id, type FROM E UNION SELECT dst, type FROM E) SELECT V.id AS node, coalesce(string_agg(type, ',' ORDER BY type), '') AS types FROM V LEFT JOIN B USING (id) GROUP BY V.id"
add("node_relationship_types", geo, lambda g: g.call("node.relationship_types", 100).select(F.array_join("relationship_types", ",").alias("types")), GEO, "SELECT string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM E WHERE src = 100 OR dst = 100")
add("label_exists", geo, lambda g: g.V.select("id", g.call("label.exists", F.col("labels"), "Nation").alias("e")), GEO, "SELECT id, label = 'Nation' AS e FROM V")
add("meta_stats_offline", geo, lambda g: g.call("meta.stats_offline").select("labelCount", "relationshipTypeCount", "nodeCount", "relationshipCount", F.col("labels")["Customer"].alias("customers"), F.col("relationshipTypes")["(:Nation)-[:IN_REGION]->()"].alias("pattern")), GEO,
    "SELECT 4 AS labelCount, 2 AS relationshipTypeCount, (SELECT count(*) FROM V) AS nodeCount, (SELECT count(*) FROM E) AS relationshipCount, (SELECT count(*) FROM V WHERE label = 'Customer') AS customers, (SELECT count(*) FROM nation) AS pattern")
add("meta_stats_online", geo, lambda g: g.call("meta.stats_online").select("nodeCount", "relationshipCount"), GEO, "SELECT (SELECT count(*) FROM V) AS nodeCount, (SELECT count(*) FROM E) AS relationshipCount")
add("meta_util_schema", geo, lambda g: g.call("meta_util.schema").select("kind", F.array_join("start", ",").alias("start"), "type", F.array_join("end", ",").alias("end"), "count"), GEO, "SELECT 'node' AS kind, label AS start, NULL AS type, NULL AS \"end\", count(*) AS count FROM V GROUP BY label UNION ALL SELECT 'relationship', a.label, type, b.label, count(*) FROM E JOIN V a ON a.id = src JOIN V b ON b.id = dst GROUP BY ALL")
add("llm_util_schema", geo, lambda g: g.call("llm_util.schema", "raw").select("kind", "name"), GEO, "SELECT DISTINCT 'node' AS kind, label AS name FROM V UNION ALL SELECT DISTINCT 'relationship', type FROM E UNION ALL SELECT DISTINCT 'pattern', '(:' || a.label || ')-[:' || type || ']->(:' || b.label || ')' FROM E JOIN V a ON a.id = src JOIN V b ON b.id = dst")
add("graph_analyzer_analyze", geo, lambda g: g.call("graph_analyzer.analyze", ["nodes", "edges", "bridges", "self_loops", "is_dag", "is_forest"]), GEO, "SELECT * FROM (VALUES ('nodes', (SELECT count(*) FROM V)::VARCHAR), ('edges', (SELECT count(*) FROM E)::VARCHAR), ('bridges', (SELECT count(*) FROM E)::VARCHAR), ('self_loops', '0'), ('is_dag', 'True'), ('is_forest', 'true')) AS t(name, value)")
add("periodic_delete", geo, lambda g: g.call("periodic.delete", {"batch_size": 100, "labels": ["Customer"]}), GEO, "SELECT true AS success, (n // 100 + 1) * 2 AS number_of_executed_batches, n AS number_of_deleted_nodes, n AS number_of_deleted_relationships FROM (SELECT count(*) AS n FROM customer)")
_edits: dict[str, tuple[Callable[[G.PropertyGraph], G.PropertyGraph], str]] = {
    "create_node": (lambda g: g.call("create.node", ["New"], {"a": 1}), "(SELECT count(*) + 1 FROM V) AS v, (SELECT count(*) FROM E) AS e"),
    "create_nodes": (lambda g: g.call("create.nodes", ["New"], [{"a": 1}, {"a": 2}]), "(SELECT count(*) + 2 FROM V) AS v, (SELECT count(*) FROM E) AS e"),
    "create_relationship": (lambda g: g.call("create.relationship", 0, "NEXT", {}, 1), "(SELECT count(*) FROM V) AS v, (SELECT count(*) + 1 FROM E) AS e"),
    "merge_node": (lambda g: g.call("merge.node", ["Region"], {"name": "ASIA"}, {}, {"seen": 1}), "(SELECT count(*) FROM V) AS v, (SELECT count(*) FROM E) AS e"),
    "merge_relationship": (lambda g: g.call("merge.relationship", 0, "NEXT", {}, {}, 1), "(SELECT count(*) FROM V) AS v, (SELECT count(*) + 1 FROM E) AS e"),
    "nodes_delete": (lambda g: g.call("nodes.delete", [0]), "(SELECT count(*) - 1 FROM V) AS v, (SELECT count(*) FROM E WHERE dst <> 0) AS e"),
    "nodes_link": (lambda g: g.call("nodes.link", [0, 1, 2], "NEXT"), "(SELECT count(*) FROM V) AS v, (SELECT count(*) + 2 FROM E) AS e"),
    "refactor_clone_nodes": (lambda g: g.call("refactor.clone_nodes", [0], True), "(SELECT count(*) + 1 FROM V) AS v, (SELECT count(*) FROM E) + (SELECT count(*) FROM E WHERE dst = 0) AS e"),
    "refactor_clone_subgraph": (lambda g: g.call("refactor.clone_subgraph", g.V.filter("id < 1000").select("id")), "(SELECT count(*) FROM V) + (SELECT count(*) FROM V WHERE id < 1000) AS v, (SELECT count(*) FROM E) + (SELECT count(*) FROM nation) AS e"),
    "refactor_extract_node": (lambda g: g.call("refactor.extract_node", g.E.filter("type = 'IN_REGION'").select("id"), ["Link"], "OUT", "IN"), "(SELECT count(*) FROM V) + (SELECT count(*) FROM nation) AS v, (SELECT count(*) FROM E) + (SELECT count(*) FROM nation) AS e"),
    "refactor_merge_nodes": (lambda g: g.call("refactor.merge_nodes", [0, 1], {"mergeRels": True}), "(SELECT count(*) - 1 FROM V) AS v, (SELECT count(*) FROM E) AS e"),
    "refactor_categorize": (lambda g: g.call("refactor.categorize", "name", "NAMED", True, "Name", "value"), "(SELECT count(*) FROM V) + (SELECT count(DISTINCT name) FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer)) AS v, (SELECT count(*) FROM E) + (SELECT count(*) FROM V) AS e"),
}
for _n, (_f, _q) in _edits.items():
    add(_n, geo, lambda g, f=_f: (lambda h: h.V.agg(F.count(F.lit(1)).alias("v")).crossJoin(F.broadcast(h.E.agg(F.count(F.lit(1)).alias("e")))))(f(g)), GEO, f"SELECT {_q}")
add("refactor_invert", geo, lambda g: g.call("refactor.invert", g.E.filter("type = 'IN_REGION'").select("id")).E.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), GEO, "SELECT CASE type WHEN 'IN_REGION' THEN dst ELSE src END AS src, CASE type WHEN 'IN_REGION' THEN src ELSE dst END AS dst, 1 AS n FROM E")
add("refactor_rename_label", geo, lambda g: g.call("refactor.rename_label", "Nation", "Country").V.select(F.explode("labels").alias("label")).groupBy("label").count(), GEO, "SELECT CASE label WHEN 'Nation' THEN 'Country' ELSE label END AS label, count(*) AS count FROM V GROUP BY 1")
add("refactor_rename_type", geo, lambda g: g.call("refactor.rename_type", "IN_REGION", "PART_OF").E.groupBy("type").count(), GEO, "SELECT CASE type WHEN 'IN_REGION' THEN 'PART_OF' ELSE type END AS type, count(*) AS count FROM E GROUP BY 1")
add("create_set_property", geo, lambda g: g.call("create.set_property", g.V.filter("id < 5").select("id"), "k", 7).V.groupBy(F.col("props")["k"].alias("k")).count(), GEO, "SELECT CASE WHEN id < 5 THEN '7' END AS k, count(*) AS count FROM V GROUP BY 1")
add("embeddings_node_sentence", geo, lambda g: g.call("embeddings.node_sentence").V.select("id", F.size("embedding").alias("n")), GEO, "SELECT id, 256 AS n FROM V")

# ---- functions over lists and texts -----------------------------------------------------


def orders(spark: SparkSession, d: str) -> DataFrame:
    """(k, q: sorted quantities, p: sorted parts modulo 7) of each order."""
    line = G.load(spark, d, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"), F.sort_array(F.collect_list(F.col("l_partkey") % 7)).alias("p"))


_LISTS = "L AS (SELECT l_orderkey AS k, list(l_quantity::BIGINT ORDER BY l_quantity) AS q, list(l_partkey % 7 ORDER BY l_partkey % 7) AS p FROM lineitem GROUP BY 1)"
_text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


def over_lists(name: str, column: Callable[[], object], sql: str) -> None:
    QUERIES[name] = lambda spark, d: orders(spark, d).select("k", column().alias("r"))
    SQL[name] = f"WITH {_LISTS} SELECT k, {sql} AS r FROM L"


over_lists("collections_sum", lambda: C.sum_("q"), "list_sum(q)::DOUBLE")
over_lists("collections_sum_longs", lambda: C.sum_longs("q"), "list_sum(q)::BIGINT")
over_lists("collections_avg", lambda: F.round(C.avg("q"), 6), "round(list_avg(q), 6)")
over_lists("collections_min", lambda: C.min_("q"), "list_min(q)")
over_lists("collections_max", lambda: C.max_("q"), "list_max(q)")
over_lists("collections_sort", lambda: _text(C.sort(F.reverse("q"))), "array_to_string(q, ',')")
over_lists("collections_contains", lambda: C.contains("p", F.lit(3).cast("long")), "list_contains(p, 3)")
over_lists("collections_contains_sorted", lambda: C.contains("p", F.lit(2).cast("long")), "list_contains(p, 2)")
over_lists("collections_contains_all", lambda: C.contains_all("p", F.expr("array(1L, 2L)")), "list_has_all(p, [1, 2])")
over_lists("collections_union", lambda: _text(F.sort_array(C.union("p", F.expr("array(1L, 99L)")))), "array_to_string(list_sort(list_distinct(list_concat(p, [1, 99]))), ',')")
over_lists("collections_union_all", lambda: _text(C.union_all("p", "q")), "array_to_string(list_concat(p, q), ',')")
over_lists("collections_intersection", lambda: _text(F.sort_array(C.intersection("p", "q"))), "array_to_string(list_sort(list_intersect(p, q)), ',')")
over_lists("collections_remove_all", lambda: _text(C.remove_all("p", F.expr("array(1L, 2L)"))), "array_to_string([x for x in p if x not in (1, 2)], ',')")
over_lists("collections_to_set", lambda: _text(F.sort_array(C.to_set("p"))), "array_to_string(list_sort(list_distinct(p)), ',')")
over_lists("collections_pairs", lambda: F.array_join(F.transform(C.pairs("q"), lambda x: F.concat(F.get(x, F.lit(0)).cast("string"), F.lit("-"), F.coalesce(F.get(x, F.lit(1)).cast("string"), F.lit("")))), ","), "array_to_string([q[i]::VARCHAR || '-' || coalesce(q[i + 1]::VARCHAR, '') for i in range(1, len(q) + 1)], ',')")
over_lists("collections_flatten", lambda: _text(C.flatten(F.array("p", "q"))), "array_to_string(list_concat(p, q), ',')")
over_lists("collections_frequencies_as_map", lambda: F.coalesce(C.frequencies_as_map("p")["3"], F.lit(0)).cast("long"), "len([x for x in p if x = 3])")
over_lists("collections_split", lambda: F.size(C.split_column("p", F.lit(3).cast("long"))).cast("long"), "CASE WHEN len(p) = 0 THEN 1 WHEN NOT list_contains(p, 3) THEN 1 ELSE (len([x for x in p if x < 3]) > 0)::BIGINT + (len([x for x in p if x > 3]) > 0)::BIGINT END")
over_lists("collections_partition", lambda: F.array_join(F.transform(C.partition_column("q", 2), lambda x: F.size(x).cast("string")), ","), "array_to_string([least(2, len(q) - i) for i in range(0, len(q), 2)], ',')")
over_lists("map_from_lists", lambda: F.size(maps.from_lists(F.transform("q", lambda x: x.cast("string")), F.transform("q", lambda x: x.cast("string")))).cast("long"), "len(list_distinct(q))")
over_lists("map_merge", lambda: F.size(maps.merge(F.map_from_arrays(F.transform(F.array_distinct("p"), lambda x: x.cast("string")), F.transform(F.array_distinct("p"), lambda x: x.cast("string"))), F.expr("map('1', 'a', '99', 'b')"))).cast("long"), "len(list_distinct(list_concat(p, [1, 99])))")
over_lists("map_set_key", lambda: maps.set_key(F.expr("map('a', '1')"), "b", F.size("q").cast("string"))["b"], "len(q)::VARCHAR")
over_lists("map_remove_key", lambda: F.size(maps.remove_key(F.expr("map('a', '1', 'b', '2')"), "a")).cast("long"), "1")
over_lists("map_from_values", lambda: maps.from_values(F.array(F.lit("a"), F.size("q").cast("string")))["a"], "len(q)::VARCHAR")
over_lists("map_from_pairs", lambda: maps.from_pairs(F.array(F.array(F.lit("a"), F.size("q").cast("string"))))["a"], "len(q)::VARCHAR")
over_lists("math_round", lambda: text.round_(C.avg("q"), 1, "FLOOR"), "floor(list_avg(q) * 10) / 10")
over_lists("text_join", lambda: text.join(F.transform("q", lambda x: x.cast("string")), "-"), "array_to_string(q, '-')")


def over(name: str, table: str, key: str, column: Callable[[], object], sql: str, where: str = "") -> None:
    QUERIES[name] = lambda spark, d: (lambda t: t.filter(where) if where else t)(G.load(spark, d, table)).select(key, column().alias("r"))
    SQL[name] = f"SELECT {key}, {sql} AS r FROM {table}" + (f" WHERE {where}" if where else "")


over("text_replace", "documents", "doc_id", lambda: F.md5(text.replace("text", "the", "[x]")), "md5(replace(text, 'the', '[x]'))")
over("text_regreplace", "documents", "doc_id", lambda: F.md5(text.regreplace("text", "[0-9]+", "#")), "md5(regexp_replace(text, '[0-9]+', '#', 'g'))")
over("text_regex_groups", "events", "event_id", lambda: F.array_join(F.flatten(text.regex_groups("props", r'"(\w)": (\d+)')), "|"), "NULL")
SQL["text_regex_groups"] = r"""SELECT event_id, coalesce(regexp_extract(props, '"(\w)": (\d+)', 0) || '|' || regexp_extract(props, '"(\w)": (\d+)', 1) || '|' || regexp_extract(props, '"(\w)": (\d+)', 2), '') AS r FROM events"""
over("text_distance", "customer", "c_custkey", lambda: text.distance("c_name", F.concat("c_mktsegment", F.lit("#1"))), "levenshtein(c_name, c_mktsegment || '#1')")
over("text_index_of", "documents", "doc_id", lambda: text.index_of("text", "the"), "CASE WHEN strpos(text, 'the') = 0 THEN -1 ELSE strlen(substr(text, 1, strpos(text, 'the') - 1)) END")
over("text_format", "nation", "n_nationkey", lambda: text.format_("{1}/{0}", [F.col("n_name"), F.col("n_regionkey")]), "n_regionkey::VARCHAR || '/' || n_name")
over("util_module_md5", "documents", "doc_id", lambda: text.md5(F.col("text")), "md5(text)")
over("uuid_generator_get", "nation", "n_nationkey", lambda: F.length(text.uuid()), "36")
over("date_parse", "orders", "o_orderkey", lambda: dates.parse(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "s"), "epoch(o_orderdate)::BIGINT")
over("date_format", "orders", "o_orderkey", lambda: dates.format_(F.unix_seconds(F.col("o_orderdate").cast("timestamp")), "s", "%Y-%m-%d"), "strftime(o_orderdate, '%Y-%m-%d')")
over("date_add", "orders", "o_orderkey", lambda: dates.add(F.unix_seconds(F.col("o_orderdate").cast("timestamp")), "s", 2, "d"), "epoch(o_orderdate)::BIGINT + 172800")
over("date_convert_format", "orders", "o_orderkey", lambda: dates.convert_format(F.date_format("o_orderdate", "yyyy-MM-dd"), "iso_date", "basic_iso_date"), "strftime(o_orderdate, '%Y%m%d')")
over("temporal_format", "orders", "o_orderkey", lambda: dates.temporal_format(F.col("o_orderdate"), "%d.%m.%Y"), "strftime(o_orderdate, '%d.%m.%Y')")
over("json_util_to_json", "nation", "n_nationkey", lambda: documents.to_json(F.struct("n_nationkey", "n_name")), "'{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'")
over("json_util_from_json_list", "events", "event_id", lambda: F.size(documents.from_json_list(F.concat(F.lit("["), "props", F.lit(",1]")))), "2")
over("distance_calculator_single", "nation", "n_nationkey", lambda: text.distance_single(F.struct(F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lng")), F.struct(F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng")), "km", 2), "NULL")
SQL["distance_calculator_single"] = """WITH h AS (SELECT n_nationkey, pow(sin(radians(10.0 - n_nationkey) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(10.0)) * pow(sin(radians(20.0 - n_regionkey) / 2), 2) AS a FROM nation)
SELECT n_nationkey, round(6371000.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) * 0.001, 2) AS r FROM h"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
