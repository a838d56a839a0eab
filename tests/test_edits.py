import json

import pytest
from pyspark.sql import functions as F

from grafloom.graph import PropertyGraph
from grafloom.sources import migrate
from grafloom.streaming.online import OnlineStats


@pytest.fixture
def g(spark):
    vs = [(0, ["Ana"], {"name": "a", "city": "X"}), (1, ["Bo"], {"name": "b", "city": "X"}), (2, ["Cy"], {"name": "c"})]
    return PropertyGraph.of(spark, vs, [(0, 1, "KNOWS", {"since": 1}), (1, 2, "LIKES", {"w": "it's"})])


def v(graph):
    return {r.id: (sorted(r.labels), dict(r.props)) for r in graph.V.collect()}


def e(graph):
    return sorted((r.src, r.dst, r.type, dict(r.props)) for r in graph.E.collect())


def test_create_and_merge(g):
    h = g.call("create.nodes", ["New"], [{"a": 1}, {"b": None}])
    assert v(h)[3] == (["New"], {"a": "1"}) and v(h)[4] == (["New"], {})
    assert (0, 2, "R", {"k": "v"}) in e(g.call("create.relationship", 0, "R", {"k": "v"}, 2))
    assert v(g.call("create.set_properties", [0, 1], ["p", "city"], [1, None]))[0] == (["Ana"], {"name": "a", "p": "1"})
    with pytest.raises(ValueError):
        g.call("create.set_properties", [0], ["a"], [])
    assert v(g.call("create.remove_properties", [0], ["city"]))[0][1] == {"name": "a"}
    assert v(g.call("create.remove_labels", [0], ["Ana"]))[0][0] == []
    assert e(g.call("create.set_rel_property", 0, "x", 2))[0][3] == {"since": "1", "x": "2"}
    assert e(g.call("create.remove_rel_properties", [0], ["since"]))[0][3] == {}
    assert v(g.call("merge.node", ["Ana"], {"name": "a"}, {"n": 1}, {"m": 2}))[0][1]["m"] == "2"
    assert v(g.call("merge.node", ["Ana"], {"name": "z"}, {"n": 1}))[3] == (["Ana"], {"name": "z", "n": "1"})
    with pytest.raises(ValueError):
        g.call("merge.node", [""], {})
    assert len(e(g.call("merge.relationship", 0, "KNOWS", {}, {}, 1, {"y": 1}))) == 2
    with pytest.raises(ValueError):
        g.call("merge.relationship", 0, "", {}, {}, 1)


def test_copying_properties(g):
    assert v(g.call("set_property.copyPropertyNode2Node", 0, ["name"], 2, ["other"]))[2][1] == {"name": "c", "other": "a"}
    assert e(g.call("set_property.copyPropertyNode2Rel", 0, ["name"], 0, ["who"]))[0][3]["who"] == "a"
    assert v(g.call("set_property.copyPropertyRel2Node", 0, ["since"], 2, ["year"]))[2][1]["year"] == "1"
    assert e(g.call("set_property.copyPropertyRel2Rel", 0, ["since"], 1, ["since"]))[1][3]["since"] == "1"
    with pytest.raises(ValueError):
        g.call("set_property.copyPropertyNode2Node", 0, ["name"], 2, [])


def test_refactor(g):
    assert e(g.call("refactor.from", 1, 0))[1][:3] == (0, 2, "LIKES")
    assert e(g.call("refactor.to", 0, 2))[0][:3] == (0, 2, "KNOWS")
    assert e(g.call("refactor.invert", 0))[0][:2] == (1, 0)
    assert v(g.call("refactor.rename_label", "Ana", "Eve"))[0][0] == ["Eve"]
    assert v(g.call("refactor.rename_node_property", "city", "town"))[0][1] == {"name": "a", "town": "X"}
    assert e(g.call("refactor.rename_type", "KNOWS", "MET"))[0][2] == "MET"
    assert e(g.call("refactor.rename_type_property", "since", "from"))[0][3] == {"from": "1"}
    h = g.call("refactor.categorize", "city", "IN", True, "City", "name")
    assert v(h)[0][1] == {"name": "a"} and sum("City" in x[0] for x in v(h).values()) == 1 and sum(x[2] == "IN" for x in e(h)) == 2
    h = g.call("refactor.clone_nodes", [1], True, ["city"])
    clone = max(v(h))
    assert v(h)[clone] == (["Bo"], {"name": "b"}) and (0, clone, "KNOWS", {}) in e(h) and (clone, 2, "LIKES", {}) in e(h)
    h = g.call("refactor.clone_subgraph", [0, 1], None, {"standinNodes": [[0, 2]]})
    assert len(v(h)) == 4 and any(x[0] == 2 and x[2] == "KNOWS" for x in e(h))
    h = g.call("refactor.collapse_node", [1], "VIA")
    assert e(h) == [(0, 2, "VIA", {"name": "b", "city": "X"})]
    with pytest.raises(ValueError):
        g.call("refactor.collapse_node", [0], "VIA")
    h = g.call("refactor.extract_node", [0], ["Link"], "OUT", "IN")
    assert sorted(x[2] for x in e(h)) == ["IN", "LIKES", "OUT"]
    path = {"nodes": [0, 1, 2], "rels": [0, 1]}
    assert e(g.call("refactor.delete_and_reconnect", path, [1])) == [(0, 2, "KNOWS", {"since": "1"})]
    assert e(g.call("refactor.delete_and_reconnect", path, [1], {"relationshipSelectionStrategy": "merge"})) == [(0, 2, "KNOWS_LIKES", {"since": "1", "w": "it's"})]
    assert v(g.call("refactor.normalize_as_boolean", [0, 1, 2], "name", ["a"], ["b"]))[2][1] == {}
    h = g.call("refactor.merge_nodes", [0, 1], {"mergeRels": True})
    assert v(h)[0] == (["Ana", "Bo"], {"name": "[a,b]", "city": "X"}) and e(h)[0][:2] == (0, 0)
    assert e(g.call("refactor.merge_nodes", [0, 1], {"properties": "discard"})) == []


def test_export_and_import(g, spark, tmp_path):
    g.call("export_util.json", str(tmp_path / "j"))
    h = g.call("import_util.json", spark, str(tmp_path / "j"))
    assert v(h) == v(g) and e(h) == e(g)
    text = g.call("export_util.json", "", {"stream": True}).first().data
    (tmp_path / "one.json").write_text(text)
    assert v(g.call("import_util.json", spark, str(tmp_path / "one.json"))) == v(g) and len(json.loads(text)) == 5
    (tmp_path / "bad.json").write_text('{"id": 1, "type": "node"}')
    with pytest.raises(ValueError):
        g.call("import_util.json", spark, str(tmp_path / "bad.json"))
    for style in ("", "GEPHI", "TINKERPOP"):
        g.call("export_util.graphml", str(tmp_path / "g.xml"), {"format": style})
        h = g.call("import_util.graphml", spark, str(tmp_path / "g.xml"), {"readLabels": True})
        assert sorted(v(h).values()) == sorted(v(g).values()) and [x[2:] for x in e(h)] == [x[2:] for x in e(g)]
    g.call("export_util.cypher_all", str(tmp_path / "c"))
    h = g.call("import_util.cypher", spark, str(tmp_path / "c"))
    assert v(h) == v(g) and e(h) == e(g)
    (tmp_path / "x.txt").write_text("MATCH (n) DELETE n;")
    with pytest.raises(ValueError):
        g.call("import_util.cypher", spark, str(tmp_path / "x.txt"))
    assert g.call("export_util.csv_graph", path="", config={"stream": True}).first().data.splitlines()[0] == "_id,_labels,city,name,since,w,_start,_end,_type"
    with pytest.raises(ValueError):
        g.call("export_util.csv_query", g.V.limit(0))
    name = g.call("csv_utils.create_csv_file", str(tmp_path / "t.csv"), "a,b\n1,2\n")
    g.call("csv_utils.create_csv_file", name, "3,4\n", True)
    assert [tuple(r) for r in g.call("migrate.s3", spark, name).collect()] == [("1", "2"), ("3", "4")]
    g.call("csv_utils.delete_csv_file", name)
    assert not (tmp_path / "t.csv").exists()


def test_readers(spark):
    df = migrate.duckdb_(spark, "SELECT 1.50::DECIMAL(5,2) AS d, DATE '2024-01-02' AS t, 'x' AS s FROM t", ["CREATE TABLE t AS SELECT 1"])
    assert tuple(df.first()) == (1.5, "2024-01-02", "x")
    assert migrate.bound("a = %(x)s AND b = :y", {"x": "o'k", "y": 2}) == "a = 'o''k' AND b = 2"
    assert migrate.bound("a = ? AND b = %s", [None, True]) == "a = NULL AND b = TRUE"
    assert migrate.graph_query("(:Person)").startswith("MATCH (n:Person)") and migrate.graph_query("[:R]").startswith("MATCH (n)-[r:R]")
    with pytest.raises(RuntimeError):
        migrate.neo4j_(spark, "(:A)", {})


def test_statistics_follow_a_stream(g, spark, tmp_path):
    online = OnlineStats(g)
    schema = "event string, labels array<string>, type string, keys array<string>, src_labels array<string>, dst_labels array<string>"
    events = [("created_vertex", ["Ana", "Di"], None, ["name"], [], []), ("deleted_edge", [], "LIKES", ["w"], ["Bo"], ["Cy"]), ("removed_label", ["Cy"], None, [], [], [])]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(events, schema).write.mode("append").json(str(tmp_path / "in"))
    q = online.follow(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    s = online.stats().first()
    assert (s.nodeCount, s.relationshipCount, s.labels, s.relationshipTypesCount) == (4, 1, {"Ana": 2, "Bo": 1, "Di": 1}, {"KNOWS": 1})
    assert s.relationshipTypes == {"()-[:KNOWS]->()": 1, "(:Ana)-[:KNOWS]->()": 1, "()-[:KNOWS]->(:Bo)": 1}
    online.update(spark.createDataFrame(events, schema), batch=0)
    assert online.stats().first().nodeCount == 4


def test_metadata_and_control(g, spark):
    s = g.call("meta.stats_offline").first()
    assert (s.nodeCount, s.labelCount, s.propertyKeyCount) == (3, 3, 4)
    text = g.call("llm_util.schema").first()[0]
    assert "(:Ana)-[:KNOWS]->(:Bo)" in text and "- since: int" in text
    with pytest.raises(ValueError):
        PropertyGraph.of(spark, [], []).call("meta_util.schema")
    assert {r.kind for r in g.call("meta_util.schema", True).collect()} == {"node", "relationship"}
    seen = []
    out = g.call("periodic.iterate", lambda h: h.V.select("id"), lambda df, i: seen.append(sorted(r.id for r in df.collect())), {"batch_size": 2}).first()
    assert out.number_of_executed_batches == 2 and sorted(x for s in seen for x in s) == [0, 1, 2]
    with pytest.raises(ValueError):
        g.call("periodic.iterate", lambda h: h.V, lambda df, i: None, {})
    assert v(g.call("periodic.deleted", {"batch_size": 1, "labels": ["Ana"]})).keys() == {1, 2}
    pick = lambda h, p: h.spark.createDataFrame([(p["x"],)], "x int")
    assert g.call("do.when", False, None, pick, {"x": 3}).first().x == 3
    assert g.call("do.case", [False, None, True, pick], None, {"x": 4}).first().x == 4
    with pytest.raises(ValueError):
        g.call("do.case", [True], pick)
    values = {r.name: r.value for r in g.call("graph_analyzer.analyze").collect()}
    assert values["nodes"] == "3" and values["bridges"] == "2" and values["is_dag"] == "True" and values["articulation_points"] == "1"
    with pytest.raises(ValueError):
        g.call("graph_analyzer.analyze", ["nonsense"])
    assert g.call("rust_example.test_procedure").count() == 3 and g.call("rust_example.basic", "a", 2).first().output_int == 2


def test_learning(spark):
    rows = [(i, ["P"], {"class": "x" if i < 10 else "y", "features": str([float(i < 10), i % 3 / 3])}) for i in range(20)]
    edges = [(i, j) for i in range(20) for j in range(i + 1, 20) if (i < 10) == (j < 10) and (i + j) % 3]
    g = PropertyGraph.of(spark, rows, edges)
    assert g.call("node2vec.get_embeddings", vector_size=4, epochs=1).count() == 20
    g.call("node_classification.reset")
    g.call("node_classification.train", 20)
    got = dict((r.node, r.predicted_class) for r in g.call("node_classification.predict", list(range(20))).collect())
    assert got == {i: "x" if i < 10 else "y" for i in range(20)}
    g.call("link_prediction.reset_parameters")
    with pytest.raises(ValueError):
        g.call("link_prediction.predict", 0, 1)
    assert {r.part for r in g.call("link_prediction.train").collect()} >= {"training"}
    likely, unlikely = (g.call("link_prediction.predict", 0, b).first().score for b in (9, 15))
    assert likely > unlikely
    assert g.call("link_prediction.recommend", 0, [3, 15, 6], 2).count() == 2
    g.call("tgn.reset")
    g.call("tgn.update", g.E.select("id", "src", "dst"))
    assert g.call("tgn.get").count() == 20 and 0 <= g.call("tgn.predict_link_score", 0, 1).first()[0] <= 1
    with pytest.raises(NotImplementedError):
        g.call("tgn.save_tgn_params")
    assert len(g.call("embeddings.text", ["a b", "c"]).first().embedding) == 256


def test_functions(spark):
    from grafloom.functions import collections as C
    from grafloom.functions import dates, documents, text

    one = spark.createDataFrame([([3, 1, None, 2],)], "a array<int>")
    assert one.select(C.pairs("a")).first()[0] == [[3, 1], [1, None], [None, 2], [2, None]]
    assert C.split(one, "a", F.lit(1)).count() == 2 and C.partition(one, "a", 3).count() == 2
    value = lambda c: spark.range(1).select(c).first()[0]
    assert [value(text.round_(F.lit(-2.5), 0, m)) for m in ("UP", "DOWN", "CEILING", "FLOOR", "HALF_UP", "HALF_DOWN", "HALF_EVEN")] == [-3, -2, -2, -3, -3, -2, -2]
    with pytest.raises(ValueError):
        text.round_(1.0, 0, "SIDEWAYS")
    assert value(text.index_of(F.lit("éa b a"), "a", 3)) == 6 and value(text.index_of(F.lit("abc"), "c", 0, 2)) == -1
    assert value(text.regex_groups(F.lit("a1b22"), r"([a-z])(\d+)")) == [["a1", "a", "1"], ["b22", "b", "22"]]
    assert value(text.format_("{} {{x}} {0}", [F.lit(1)])) == "1 {x} 1"
    assert value(dates.parse(F.lit("2024-01-01 00:00:00"), "h")) == 473352 and value(dates.parse(F.lit("01/02/2024"), "d", "%d/%m/%Y", "+0200")) == 19753
    assert value(dates.convert_format(F.lit("2024-02-03"), "iso_date", "iso_ordinal_date")) == "2024-034"
    with pytest.raises(ValueError):
        dates.temporal_format(F.lit("x"), "%z")
    assert documents.parse_xml('<a k="1">t<b/></a>') == [{"_type": "a", "k": "1", "_text": "t", "_children": [{"_type": "b"}]}]
    assert documents.load_from_str(spark, '[{"a": 1}, 2]').count() == 2
    with pytest.raises(ValueError):
        documents.parse_xml("<!DOCTYPE a><a/>")
