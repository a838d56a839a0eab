"""Queries of edits, files, subgraphs, learning and control, which need arguments made from the graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G
from .functions import dates, documents, maps, text
from .plans.lineage import shared_dir
from .queries import GEO, NATIONS, QUERIES, SQL, _r, add, flow, geo, nations, over, over_lists, vectors

SMALL = "id < 1000"  # regions and nations


def marked(s, d) -> G.PropertyGraph:
    """The geography, with every node's and edge's facts in props."""
    g = geo(s, d)
    v = g.V.withColumn("props", F.map_from_arrays(F.array(F.lit("title"), F.lit("flag")), F.array("name", F.when(F.col("id") % 2 == 0, "yes").otherwise("no"))))
    return G.PropertyGraph(v.drop("name"), g.E.withColumn("props", F.map_from_arrays(F.array(F.lit("kind")), F.array(F.lower("type")))))


def keys_of(df: DataFrame, *names: str) -> DataFrame:
    """How many rows have each value of properties."""
    return df.groupBy(*[F.col("props")[n].alias(n) for n in names]).agg(F.count(F.lit(1)).alias("n"))


def ids(g: G.PropertyGraph) -> DataFrame:
    return g.V.filter(SMALL).select("id")


def rels(g: G.PropertyGraph) -> DataFrame:
    return g.E.filter("type = 'IN_REGION'").select("id")


def in_region(g: G.PropertyGraph, dst: int = 0) -> list[int]:
    """Edge ids into a region, by source."""
    return [r["id"] for r in g.E.filter((F.col("dst") == dst) & (F.col("type") == "IN_REGION")).orderBy("src").select("id").collect()]


# ---- edits -----------------------------------------------------------------------

_V = "SELECT {a}, count(*) AS n FROM V GROUP BY ALL"
add("create_set_properties", marked, lambda g: keys_of(g.call("create.set_properties", ids(g), ["a", "flag"], [1, None]).V, "a", "flag"), GEO, _V.format(a="CASE WHEN id < 1000 THEN '1' END AS a, CASE WHEN id >= 1000 THEN CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END END AS flag"))
add("create_remove_properties", marked, lambda g: keys_of(g.call("create.remove_properties", ids(g), ["flag"]).V, "flag"), GEO, _V.format(a="CASE WHEN id >= 1000 THEN CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END END AS flag"))
add("create_remove_labels", geo, lambda g: g.call("create.remove_labels", ids(g), ["Nation"]).V.groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count(F.lit(1)).alias("n")), GEO, _V.format(a="CASE label WHEN 'Nation' THEN '' ELSE label END AS labels"))
_E = "SELECT {a}, count(*) AS n FROM E GROUP BY ALL"
add("create_set_rel_property", marked, lambda g: keys_of(g.call("create.set_rel_property", rels(g), "k", 5).E, "k"), GEO, _E.format(a="CASE type WHEN 'IN_REGION' THEN '5' END AS k"))
add("create_set_rel_properties", marked, lambda g: keys_of(g.call("create.set_rel_properties", rels(g), ["k", "kind"], [5, "x"]).E, "k", "kind"), GEO, _E.format(a="CASE type WHEN 'IN_REGION' THEN '5' END AS k, CASE type WHEN 'IN_REGION' THEN 'x' ELSE lower(type) END AS kind"))
add("create_remove_rel_properties", marked, lambda g: keys_of(g.call("create.remove_rel_properties", rels(g), ["kind"]).E, "kind"), GEO, _E.format(a="CASE WHEN type <> 'IN_REGION' THEN lower(type) END AS kind"))
add("set_property_copyPropertyNode2Node", marked, lambda g: keys_of(g.call("set_property.copyPropertyNode2Node", 0, ["flag"], 1, ["other"]).V, "other"), GEO, _V.format(a="CASE id WHEN 1 THEN 'yes' END AS other"))
add("set_property_copyPropertyNode2Rel", marked, lambda g: keys_of(g.call("set_property.copyPropertyNode2Rel", 0, ["flag"], in_region(g)[0], ["other"]).E, "other"), GEO, "SELECT CASE n WHEN 1 THEN 'yes' END AS other, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY dst <> 0 OR type <> 'IN_REGION', src) AS n FROM E) GROUP BY 1")
add("set_property_copyPropertyRel2Node", marked, lambda g: keys_of(g.call("set_property.copyPropertyRel2Node", in_region(g)[0], ["kind"], 1, ["other"]).V, "other"), GEO, _V.format(a="CASE id WHEN 1 THEN 'in_region' END AS other"))
add("set_property_copyPropertyRel2Rel", marked, lambda g: keys_of(g.call("set_property.copyPropertyRel2Rel", in_region(g)[0], ["kind"], in_region(g)[1], ["other"]).E, "other"), GEO, "SELECT CASE n WHEN 2 THEN 'in_region' END AS other, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY dst <> 0 OR type <> 'IN_REGION', src) AS n FROM E) GROUP BY 1")
add("refactor_from", geo, lambda g: g.call("refactor.from", rels(g), 0).E.groupBy("src").agg(F.count(F.lit(1)).alias("n")), GEO, "SELECT CASE type WHEN 'IN_REGION' THEN 0 ELSE src END AS src, count(*) AS n FROM E GROUP BY 1")
add("refactor_to", geo, lambda g: g.call("refactor.to", rels(g), 0).E.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), GEO, "SELECT CASE type WHEN 'IN_REGION' THEN 0 ELSE dst END AS dst, count(*) AS n FROM E GROUP BY 1")
add("refactor_rename_label_count", geo, lambda g: g.call("refactor.rename_label_count", "Nation", "Country"), GEO, "SELECT count(*) AS nodes_changed FROM V WHERE label = 'Nation'")
add("refactor_rename_node_property", marked, lambda g: keys_of(g.call("refactor.rename_node_property", "flag", "mark", ids(g)).V, "flag", "mark"), GEO, _V.format(a="CASE WHEN id >= 1000 THEN CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END END AS flag, CASE WHEN id < 1000 THEN CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END END AS mark"))
add("refactor_rename_type_property", marked, lambda g: keys_of(g.call("refactor.rename_type_property", "kind", "sort", rels(g)).E, "kind", "sort"), GEO, _E.format(a="CASE WHEN type <> 'IN_REGION' THEN lower(type) END AS kind, CASE type WHEN 'IN_REGION' THEN 'in_region' END AS sort"))
add("refactor_normalize_as_boolean", marked, lambda g: keys_of(g.call("refactor.normalize_as_boolean", g.V.select("id"), "flag", ["yes"], ["no"]).V, "flag"), GEO, _V.format(a="(id % 2 = 0)::VARCHAR AS flag"))
add("refactor_clone_subgraph_from_paths", geo, lambda g: sizes(g.call("refactor.clone_subgraph_from_paths", g.call("path.create", 100, [r["id"] for r in g.E.filter("src = 100").select("id").collect()]))), GEO, "SELECT (SELECT count(*) + 2 FROM V) AS v, (SELECT count(*) + 1 FROM E) AS e")


def sizes(g: G.PropertyGraph) -> DataFrame:
    return g.V.agg(F.count(F.lit(1)).alias("v")).crossJoin(F.broadcast(g.E.agg(F.count(F.lit(1)).alias("e"))))  # one row each


def one_way(s, d) -> G.PropertyGraph:
    """A customer, its nation and its region: a path of three."""
    g = geo(s, d)
    return g.subgraph(g.call("graph_util.descendants", G.CUSTOMER + 1).union(s.createDataFrame([(G.CUSTOMER + 1,)], "id long")))


def _nation_of(g: G.PropertyGraph) -> int:
    return g.E.filter(F.col("src") == G.CUSTOMER + 1).first()["dst"]


_LINE = "C AS (SELECT a.src AS c, a.dst AS n, b.dst AS r FROM E a JOIN E b ON b.src = a.dst WHERE a.src = 2000000001)"
add("refactor_collapse_node", one_way, lambda g: g.call("refactor.collapse_node", [_nation_of(g)], "VIA").E.select("src", "dst", "type"), GEO, f"{_LINE} SELECT c AS src, r AS dst, 'VIA' AS type FROM C")


def _reconnected(g: G.PropertyGraph) -> DataFrame:
    e = {r["src"]: r for r in g.E.collect()}  # three nodes
    n = _nation_of(g)
    path = {"nodes": [G.CUSTOMER + 1, n, e[n]["dst"]], "rels": [e[G.CUSTOMER + 1]["id"], e[n]["id"]]}
    return g.call("refactor.delete_and_reconnect", path, [n], {"relationshipSelectionStrategy": "merge"}).E.select("src", "dst", "type")


add("refactor_delete_and_reconnect", one_way, _reconnected, GEO, f"{_LINE} SELECT c AS src, r AS dst, 'IN_NATION_IN_REGION' AS type FROM C")
add("graph_util_chain_nodes", geo, lambda g: g.call("graph_util.chain_nodes", [0, 1, 2, 3], "NEXT").E.filter("type = 'NEXT'").select("src", "dst"), "", "SELECT * FROM (VALUES (0, 1), (1, 2), (2, 3)) AS t(src, dst)")
SQL["graph_util_chain_nodes"] = "SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (1, 2), (2, 3)) AS t(src, dst)"

# ---- paths as values ----------------------------------------------------------------


def _path(g: G.PropertyGraph) -> DataFrame:
    n = _nation_of(g)
    e = {r["src"]: r["id"] for r in g.E.collect()}  # three nodes
    return g.call("path.create", G.CUSTOMER + 1, [e[G.CUSTOMER + 1], e[n]])


_nodes = lambda c: F.array_join(F.transform(c["nodes"], lambda x: x.cast("string")), ",").alias("nodes")
add("path_create", one_way, lambda g: _path(g).select(_nodes(F.col("path"))), GEO, f"{_LINE} SELECT c || ',' || n || ',' || r AS nodes FROM C")
add("path_elements", one_way, lambda g: _path(g).select(F.size(g.call("path.elements", F.col("path"))).alias("n")), GEO, "SELECT 5 AS n")
add("path_slice", one_way, lambda g: _path(g).select(_nodes(g.call("path.slice", F.col("path"), 1))), GEO, f"{_LINE} SELECT n || ',' || r AS nodes FROM C")
add("path_combine", one_way, lambda g: _path(g).select(_nodes(g.call("path.combine", g.call("path.slice", F.col("path"), 0, 1), g.call("path.slice", F.col("path"), 1)))), GEO, f"{_LINE} SELECT c || ',' || n || ',' || r AS nodes FROM C")

# ---- subgraphs, control, files -------------------------------------------------------

for _n in ("community_detection", "leiden_community_detection"):
    add(f"{_n}_get_subgraph", nations, lambda g, n=_n: g.call(f"{n}.get_subgraph", list(range(10)), None).select("node"), NATIONS, "S AS (SELECT * FROM E WHERE src < 10 AND dst < 10) SELECT id AS node FROM V WHERE id IN (SELECT src FROM S UNION SELECT dst FROM S)")
add("graph_coloring_color_subgraph", nations, lambda g: g.call("graph_coloring.color_subgraph", list(range(10)), None).select("node"), NATIONS, "SELECT id AS node FROM V WHERE id < 10")
add("graph_analyzer_analyze_subgraph", geo, lambda g: g.call("graph_analyzer.analyze_subgraph", ids(g), None, ["nodes", "edges", "number_of_weakly_components"]), GEO, "SELECT * FROM (VALUES ('nodes', (SELECT count(*) FROM V WHERE id < 1000)::VARCHAR), ('edges', (SELECT count(*) FROM nation)::VARCHAR), ('number_of_weakly_components', (SELECT count(*) FROM region)::VARCHAR)) AS t(name, value)")
add("graph_analyzer_help", geo, lambda g: g.call("graph_analyzer.help").agg(F.count(F.lit(1)).alias("n")), "", "SELECT 18 AS n")
SQL["graph_analyzer_help"] = "SELECT 18 AS n"
add("periodic_iterate", geo, lambda g: g.call("periodic.iterate", lambda h: h.V.select("id"), lambda df, i: None, {"batch_size": 5000}), GEO, "SELECT true AS success, ceil(count(*) / 5000)::BIGINT AS number_of_executed_batches FROM V")
add("periodic_deleted", geo, lambda g: sizes(g.call("periodic.deleted", {"batch_size": 100, "labels": ["Customer"]})), GEO, "SELECT (SELECT count(*) FROM V WHERE label <> 'Customer') AS v, (SELECT count(*) FROM E WHERE src < 2000000000) AS e")
_count = lambda h, p: h.V.filter(F.array_contains("labels", p["l"])).agg(F.count(F.lit(1)).alias("n"))
add("do_when", geo, lambda g: g.call("do.when", True, _count, _count, {"l": "Nation"}), GEO, "SELECT count(*) AS n FROM V WHERE label = 'Nation'")
add("do_case", geo, lambda g: g.call("do.case", [False, None, True, _count], _count, {"l": "Region"}), GEO, "SELECT count(*) AS n FROM V WHERE label = 'Region'")
add("rust_example_basic", geo, lambda g: g.call("rust_example.basic", "a", 2), "", "SELECT")
SQL["rust_example_basic"] = "SELECT 'a' AS output_string, 2::BIGINT AS output_int"
add("rust_example_test_procedure", geo, lambda g: g.call("rust_example.test_procedure").groupBy("first_label", "first_edge_type").agg(F.count(F.lit(1)).alias("n")), GEO, "SELECT label AS first_label, CASE label WHEN 'Region' THEN '' WHEN 'Nation' THEN 'IN_REGION' ELSE 'IN_NATION' END AS first_edge_type, count(*) AS n FROM V GROUP BY ALL")


def _path_in(g: PropertyGraph, kind: str) -> str:
    return f"{shared_dir(g.spark)}/{kind}-{uuid.uuid4().hex}"


def _round_trip(kind: str):
    """The whole graph to files and back: nodes by label and title, relationships by type and kind."""
    export = {"json": "export_util.json", "cypher": "export_util.cypher_all", "graphml": "export_util.graphml"}[kind]

    def run(g: G.PropertyGraph) -> DataFrame:
        path = _path_in(g, kind)
        g.call(export, path)
        h = g.call("import_util.graphml", g.spark, path, {"readLabels": True}) if kind == "graphml" else g.call(f"import_util.{kind}", g.spark, path)
        v = h.V.select("id", F.array_join("labels", ",").alias("what"), F.col("props")["title"].alias("value"))
        ends = h.E.join(h.V.select(F.col("id").alias("dst"), F.col("props")["title"].alias("to")), "dst")
        return v.union(ends.select("src", "type", F.concat(F.col("props")["kind"], F.lit(" "), "to")))

    return run


_NAMES = """N AS (SELECT r_regionkey::BIGINT AS id, r_name AS title FROM region UNION ALL SELECT n_nationkey::BIGINT + 100, n_name FROM nation
UNION ALL SELECT s_suppkey::BIGINT + 1000000000, s_name FROM supplier UNION ALL SELECT c_custkey::BIGINT + 2000000000, c_name FROM customer)"""
for _k in ("json", "cypher", "graphml"):
    add(f"import_util_{_k}", marked, _round_trip(_k), GEO, f"{_NAMES} SELECT id, label AS what, title AS value FROM V JOIN N USING (id) UNION ALL SELECT src, type, lower(type) || ' ' || title FROM E JOIN N ON N.id = dst")


def _file_of(export: str, **how) -> Callable[[G.PropertyGraph], DataFrame]:
    """Rows of a written export, as read back."""

    def run(g: G.PropertyGraph) -> DataFrame:
        path = _path_in(g, "export")
        g.call(export, path=path, **how)
        return g.spark.read.text(path)

    return run


add("export_util_json_graph", marked, lambda g: _file_of("export_util.json_graph", nodes=g.V.select("id"), relationships=g.E.select("id"))(g).groupBy(F.get_json_object("value", "$.type").alias("type")).agg(F.count(F.lit(1)).alias("n")), GEO,
    "Q AS (SELECT 'node' AS type FROM V UNION ALL SELECT 'relationship' FROM E) SELECT type, count(*) AS n FROM Q GROUP BY type")
add("export_util_cypher_all", marked, lambda g: _file_of("export_util.cypher_all")(g).groupBy(F.substring("value", 1, 12).alias("begin")).agg(F.count(F.lit(1)).alias("n")), GEO,
    "Q AS (SELECT 'CREATE (n:_I' AS begin FROM V UNION ALL SELECT 'MATCH (n:_IM' FROM E UNION ALL SELECT * FROM (VALUES ('CREATE INDEX'), ('MATCH (n:_IM'), ('DROP INDEX O'))) SELECT begin, count(*) AS n FROM Q GROUP BY begin")
add("export_util_json", marked, lambda g: _file_of("export_util.json")(g).select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.type").alias("type"), F.coalesce(F.get_json_object("value", "$.properties.title"), F.get_json_object("value", "$.properties.kind")).alias("value")).filter("type = 'node'"), GEO,
    f"{_NAMES} SELECT id, 'node' AS type, title AS value FROM N")


def _csv(g: G.PropertyGraph) -> DataFrame:
    path = _path_in(g, "csv")
    g.call("export_util.csv_graph", path=path)
    return g.spark.read.csv(path, header=True).select("_id", "_labels", "title", "kind", "_start", "_end", "_type")


add("export_util_csv_graph", marked, _csv, GEO, f"{_NAMES} SELECT id::VARCHAR AS _id, ':' || label AS _labels, title, NULL AS kind, NULL AS _start, NULL AS _end, NULL AS _type FROM V JOIN N USING (id) UNION ALL SELECT NULL, NULL, NULL, lower(type), src::VARCHAR, dst::VARCHAR, type FROM E")


def _csv_query(g: G.PropertyGraph) -> DataFrame:
    path = _path_in(g, "csv")
    g.call("export_util.csv_query", g.V.select("id", "name"), path)
    return g.spark.read.csv(path, header=True, schema="id long, name string")


add("export_util_csv_query", geo, _csv_query, GEO, f"{_NAMES} SELECT id, title AS name FROM N")
add("export_util_graphml", marked, lambda g: _file_of("export_util.graphml")(g).groupBy(F.regexp_extract("value", "^</?([a-z]+)", 1).alias("tag")).agg(F.count(F.lit(1)).alias("n")).filter("tag in ('node', 'edge')"), GEO,
    "Q AS (SELECT 'node' AS tag FROM V UNION ALL SELECT 'edge' FROM E) SELECT tag, count(*) AS n FROM Q GROUP BY tag")
QUERIES["migrate_duckdb"] = lambda spark, d: G.PropertyGraph.call(None, "migrate.duckdb", spark, "SELECT * FROM n WHERE n_regionkey = 1", [f"CREATE TABLE n AS SELECT * FROM '{d}/nation.parquet'"])
SQL["migrate_duckdb"] = "SELECT * FROM nation WHERE n_regionkey = 1"

# ---- online and learned ---------------------------------------------------------------


add("map_from_nodes", geo, lambda g: g.call("map.from_nodes", "Nation", "name").select("key", "identity"), "", "SELECT")
SQL["map_from_nodes"] = "SELECT n_name AS key, n_nationkey::BIGINT + 100 AS identity FROM nation"
add("node2vec_get_embeddings", nations, lambda g: g.call("node2vec.get_embeddings", vector_size=8, epochs=1).select("nodes", F.size("embeddings").alias("n")), NATIONS, "SELECT id AS nodes, 8 AS n FROM V")
add("embeddings_text", nations, lambda g: g.call("embeddings.text", ["a b", "c"]).select("text", F.size("embedding").alias("n")), "", "SELECT")
SQL["embeddings_text"] = "SELECT * FROM (VALUES ('a b', 256), ('c', 256)) AS t(text, n)"
add("kmeans_set_clusters", vectors, lambda g: g.call("kmeans.set_clusters", 3).V.filter("cluster_id is not null").agg(F.count(F.lit(1)).alias("n")), "", "SELECT")
SQL["kmeans_set_clusters"] = "SELECT count(*) AS n FROM embeddings"


def _linked(g: G.PropertyGraph) -> DataFrame:
    g.call("link_prediction.reset_parameters")
    g.call("link_prediction.train")
    return g.call("link_prediction.recommend", 0, [1, 2, 3, 4], 2).agg(F.count(F.lit(1)).alias("n"))


add("link_prediction_recommend", lambda s, d: nations(s, d).subgraph(list(range(25))), _linked, "", "SELECT")
SQL["link_prediction_recommend"] = "SELECT 2 AS n"
add("tgn_update", nations, lambda g: (g.call("tgn.reset"), g.call("tgn.update", g.E.select("id", "src", "dst")), g.call("tgn.get").select("node"))[2], NATIONS, "SELECT src AS node FROM E UNION SELECT dst FROM E")

# ---- combinatorial and functions --------------------------------------------------------


def placed(s, d) -> G.PropertyGraph:
    n = G.load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.lit("Location")).alias("labels"), F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_regionkey") * 7 % 11).cast("double").alias("lng"))
    return G.PropertyGraph(n, s.createDataFrame([], G.E_SCHEMA))


add("tsp_solve", placed, lambda g: g.call("tsp.solve", g.V.select("id")).select("sources"), "", "SELECT")
SQL["tsp_solve"] = "SELECT n_nationkey::BIGINT AS sources FROM nation"
add("vrp_route", placed, lambda g: g.call("vrp.route", 0, 3).filter("to_vertex <> 0").select("to_vertex"), "", "SELECT")
SQL["vrp_route"] = "SELECT n_nationkey::BIGINT AS to_vertex FROM nation WHERE n_nationkey <> 0"
for _k in ("greedy", "cp_solve"):
    add(f"set_cover_{_k}", nations, lambda g, k=_k: g.call(f"set_cover.{k}", [1, 2, 3, 4, 1, 2, 3, 4], [10, 10, 11, 11, 12, 13, 14, 15]), "", "SELECT")
    SQL[f"set_cover_{_k}"] = "SELECT * FROM (VALUES (10::BIGINT), (11)) AS t(containing_set)"
over_lists("map_remove_keys", lambda: F.size(maps.remove_keys(F.expr("map('a', '1', 'b', '2', 'c', '3')"), ["a", "b"])).cast("long"), "1")
over("distance_calculator_multiple", "nation", "n_nationkey", lambda: F.get(text.distance_multiple(F.array(F.struct(F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng"))), F.array(F.struct(F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng")))), F.lit(0)), "0.0")
over("xml_module_parse", "nation", "n_nationkey", lambda: F.variant_get(documents.xml_parse(F.concat(F.lit("<n>"), "n_name", F.lit("</n>"))), "$._text", "string"), "n_name")
QUERIES["map_flatten"] = lambda spark, d: (lambda t: t.select("n_nationkey", maps.flatten(t, "s")["b.c"].alias("r")))(G.load(spark, d, "nation").select("n_nationkey", F.struct(F.lit(1).alias("a"), F.struct(F.col("n_name").alias("c")).alias("b")).alias("s")))
SQL["map_flatten"] = "SELECT n_nationkey, n_name AS r FROM nation"
QUERIES["text_regex_rows"] = lambda spark, d: text.regex_rows(G.load(spark, d, "events"), "props", r'"(\w)": (\d+)').agg(F.count(F.lit(1)).alias("n"))
SQL["text_regex_rows"] = r"""SELECT sum(len(regexp_extract_all(props, '"(\w)": (\d+)')))::BIGINT AS n FROM events"""
QUERIES["date_get_date_formats"] = lambda spark, d: dates.get_date_formats(spark).select(F.size("formats").alias("n"))
SQL["date_get_date_formats"] = "SELECT 11 AS n"
QUERIES["json_util_load_from_str"] = lambda spark, d: documents.load_from_str(spark, '[{"a": 1}, {"a": 2}]').select(F.variant_get("objects", "$.a", "int").alias("a"))
SQL["json_util_load_from_str"] = "SELECT * FROM (VALUES (1), (2)) AS t(a)"
