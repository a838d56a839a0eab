"""Graphs to and from files: JSON, CSV, GraphML and a script of CREATE statements; and search-index sinks."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import E_SCHEMA, V_SCHEMA, PropertyGraph
from ..plans import storage
from ..plans.lineage import written
from ..registry import register


def node_json(g: PropertyGraph) -> DataFrame:
    return g.V.select(F.to_json(F.struct("id", "labels", F.col("props").alias("properties"), F.lit("node").alias("type"))).alias("value"))


def rel_json(g: PropertyGraph) -> DataFrame:
    return g.E.select(F.to_json(F.struct("id", F.col("src").alias("start"), F.col("dst").alias("end"), F.col("type").alias("label"), F.col("props").alias("properties"), F.lit("relationship").alias("type"))).alias("value"))


def _out(lines: DataFrame, path: str, stream: bool, head: str = "", tail: str = "", between: str = "\n") -> DataFrame:
    """(path, data): lines go to a folder of text files; with stream (small graphs) data is their text."""
    spark = lines.sparkSession
    if path:
        lines.write.mode("overwrite").text(path)
    data = head + between.join(r[0] for r in lines.collect()) + tail if stream else ""
    return spark.createDataFrame([(path, data)], "path string, data string")


@register("export_util.json")
def export_json(g: PropertyGraph, path: str = "", config: dict | None = None) -> DataFrame:
    """A line for each node, then for each relationship; streamed as one list."""
    return _out(node_json(g).union(rel_json(g)), path, bool((config or {}).get("stream", not path)), "[", "]", ",")


@register("export_util.json_graph")
def export_json_graph(g: PropertyGraph, nodes, relationships, path: str = "", config: dict | None = None) -> DataFrame:
    return export_json(g.subgraph(nodes, relationships), path, config)


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def _cypher_map(props: Column, first: Column | None = None) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(F.lit("`"), e["key"], F.lit("`: "), F.when(e["value"].rlike(r"^-?[0-9]+(\.[0-9]+)?$"), e["value"]).otherwise(_quoted(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(F.concat(F.array(first), pairs) if first is not None else pairs, ", "), F.lit("}"))


@register("export_util.cypher_all")
def export_cypher(g: PropertyGraph, path: str = "", config: dict | None = None) -> DataFrame:
    """CREATE statements: nodes with a temporary id, relationships by it, and its removal."""
    c = config or {}
    labels = F.concat(F.lit(":_IMPORT_ID"), F.array_join(F.transform("labels", lambda x: F.concat(F.lit(":`"), x, F.lit("`"))), ""))
    nodes = g.V.select(F.concat(F.lit("CREATE (n"), labels, F.lit(" "), _cypher_map(F.col("props"), F.concat(F.lit("_IMPORT_ID: "), F.col("id").cast("string"))), F.lit(");")).alias("value"))
    rels = g.E.select(F.concat(F.lit("MATCH (n:_IMPORT_ID {_IMPORT_ID: "), F.col("src").cast("string"), F.lit("}) MATCH (m:_IMPORT_ID {_IMPORT_ID: "), F.col("dst").cast("string"), F.lit("}) CREATE (n)-[:`"), "type", F.lit("` "), _cypher_map(F.col("props")), F.lit("]->(m);")).alias("value"))
    index = g.spark.createDataFrame([("CREATE INDEX ON :_IMPORT_ID(_IMPORT_ID);",)], "value string")
    end = g.spark.createDataFrame([("MATCH (n:_IMPORT_ID) REMOVE n:`_IMPORT_ID` REMOVE n._IMPORT_ID;",), ("DROP INDEX ON :_IMPORT_ID(_IMPORT_ID);",)], "value string")
    return _out(index.union(nodes).union(rels).union(end), path, bool(c.get("stream", not path)))


@register("export_util.csv_graph")
def export_csv_graph(g: PropertyGraph, nodes_list=None, relationships_list=None, path: str = "", config: dict | None = None) -> DataFrame:
    """(path, data): _id, _labels, a column for each property, _start, _end, _type."""
    c = {"delimiter": ",", "header": True, "stream": not path} | (config or {})
    own = g if nodes_list is None else g.subgraph(nodes_list, relationships_list)
    keys = sorted({r[0] for df in (own.V, own.E) for r in df.select(F.explode(F.map_keys("props"))).distinct().collect()})  # property names, not rows
    none = F.lit(None).cast("string")
    values = [F.col("props")[k].alias(k) for k in keys]
    v = own.V.select(F.col("id").cast("string").alias("_id"), F.concat(F.lit(":"), F.array_join("labels", ":")).alias("_labels"), *values, none.alias("_start"), none.alias("_end"), none.alias("_type"))
    e = own.E.select(none, none, *values, F.col("src").cast("string"), F.col("dst").cast("string"), "type")
    table = v.union(e)
    if path:
        table.write.mode("overwrite").option("sep", c["delimiter"]).option("header", c["header"]).option("quoteAll", c.get("quote", "always") == "always").csv(path)
    data = ""
    if c["stream"]:
        lines = table.select(F.to_csv(F.struct(*[F.col(f"`{x}`") for x in table.columns]), {"sep": c["delimiter"]}).alias("value"))
        data = "\n".join(([c["delimiter"].join(table.columns)] if c["header"] else []) + [r[0] for r in lines.collect()])
    return g.spark.createDataFrame([(path, data)], "path string, data string")


@register("export_util.csv_query", kind="batch")
def export_csv_query(query: DataFrame, file_path: str = "", stream: bool = False) -> DataFrame:
    """(file_path, data) of a query's rows; none raises."""
    if query.isEmpty():
        raise ValueError("the query has no rows")
    if file_path:
        query.write.mode("overwrite").option("header", True).csv(file_path)
    lines = query.select(F.to_csv(F.struct("*")).alias("value"))
    data = "\n".join([",".join(query.columns), *(r[0] for r in lines.collect())]) if stream else ""
    return query.sparkSession.createDataFrame([(file_path, data)], "file_path string, data string")


@register("export_util.graphml")
def export_graphml(g: PropertyGraph, path: str = "", config: dict | None = None) -> DataFrame:
    """(status, data): GraphML; format GEPHI adds TYPE, TINKERPOP names labels labelV and labelE.

    With a path the document's lines go to a folder of text files, which are the
    document in the order of their names; with stream (small graphs) data is it.
    """
    c = {"format": "", "stream": not path} | (config or {})
    style = c["format"].upper()
    of_node = {"TINKERPOP": "labelV", "GEPHI": "TYPE"}.get(style, "labels")
    of_edge = {"TINKERPOP": "labelE", "GEPHI": "TYPE"}.get(style, "label")
    keys = {k: sorted(r[0] for r in df.select(F.explode(F.map_keys("props"))).distinct().collect()) for k, df in (("node", g.V), ("edge", g.E))}  # names, not rows
    xml = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    data = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(F.lit('<data key="'), xml(e["key"]), F.lit('">'), xml(e["value"]), F.lit("</data>"))), "")
    labels = F.concat(F.lit(":"), F.array_join("labels", ":"))
    nodes = g.V.select(F.concat(F.lit('<node id="n'), F.col("id").cast("string"), F.lit('" labels="'), xml(labels), F.lit(f'"><data key="{of_node}">'), xml(labels), F.lit("</data>"), data, F.lit("</node>")).alias("value"))
    edges = g.E.select(F.concat(F.lit('<edge id="e'), F.col("id").cast("string"), F.lit('" source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('" label="'), xml(F.col("type")), F.lit(f'"><data key="{of_edge}">'), xml(F.col("type")), F.lit("</data>"), data, F.lit("</edge>")).alias("value"))
    named = [("node", of_node), ("edge", of_edge), *((k, x) for k in keys for x in keys[k])]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f"<key id={quoteattr(x)} for={quoteattr(k)} attr.name={quoteattr(escape(x))}/>\n" for k, x in named) + '<graph id="G" edgedefault="directed">\n'
    tail = "</graph>\n</graphml>"
    if path:
        ends = g.spark.createDataFrame([(0, head.rstrip("\n")), (3, tail)], "part int, value string")
        lines = ends.union(nodes.select(F.lit(1), "value")).union(edges.select(F.lit(2), "value"))
        # Ranges over part and line: the head comes first, edges after nodes, and no task gets all of either.
        lines.repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)
    text = head + "\n".join(r[0] for r in nodes.union(edges).collect()) + "\n" + tail if c["stream"] else ""
    return g.spark.createDataFrame([("success", text)], "status string, data string")


@register("import_util.json", kind="batch")
def import_json(spark: SparkSession, path: str) -> PropertyGraph:
    """The inverse of export_util.json, from lines or from one list; a missing key raises."""
    lines = spark.read.text(path)
    first = lines.filter(F.length(F.trim("value")) > 0).first()
    if first and first[0].lstrip().startswith("["):
        whole = spark.read.text(path, wholetext=True)
        lines = whole.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    node = F.from_json("value", "id long, labels array<string>, properties map<string,string>, type string")
    rel = F.from_json("value", "id long, start long, end long, label string, properties map<string,string>, type string")
    v = lines.select(node.alias("n")).filter("n.type = 'node'").select("n.id", "n.labels", F.col("n.properties").alias("props"))
    e = lines.select(rel.alias("r")).filter("r.type = 'relationship'").select("r.id", F.col("r.start").alias("src"), F.col("r.end").alias("dst"), F.col("r.label").alias("type"), F.col("r.properties").alias("props"))
    for df, names in ((v, ("id", "labels", "props")), (e, ("id", "src", "dst", "type", "props"))):
        missing = F.lit(False)
        for c in names:
            missing = missing | F.col(c).isNull()
        if not df.filter(missing).isEmpty():
            raise ValueError("an entry lacks a key")
    return PropertyGraph(v, e)


_ELEMENT = r"^\s*<(node|edge)\b.*(</node>|</edge>|/>)\s*$"
_GRAPHML = "kind string, name string, source string, target string, label string, props map<string,string>"


def _elements(root: ET.Element, names: dict[str, str], c: dict) -> Iterator[tuple]:
    """_GRAPHML rows of the nodes and edges within root."""
    bare = lambda tag: re.sub(r"^\{.*\}", "", tag)
    for x in root.iter():
        kind = bare(x.tag)
        if kind not in ("node", "edge"):
            continue
        props = {names.get(d.get("key"), d.get("key")): d.text or "" for d in x if bare(d.tag) == "data"}
        if kind == "node":
            label = props.pop("labels", "") or props.pop("labelV", "") or props.pop("TYPE", "") or x.get("labels", "")
            yield "node", x.get("id"), None, None, label, props | ({"id": x.get("id")} if c["storeNodeIds"] else {})
        else:
            label = x.get("label") or props.get("label") or props.get("labelE") or props.get("TYPE") or c["defaultRelationshipType"]
            for k in ("label", "labelE", "TYPE"):
                props.pop(k, None)
            yield "edge", x.get("id"), x.get("source"), x.get("target"), label, props


@register("import_util.graphml", kind="batch")
def import_graphml(spark: SparkSession, path: str = "", config: dict | None = None) -> PropertyGraph:
    """A graph with new ids: a node's is the number in its GraphML id where that is n and a number, else a hash of it.

    Lines that hold a whole node or edge each, as export_util.graphml writes
    them, are read by all tasks; any other document as a whole by the driver.
    """
    c = {"readLabels": False, "defaultRelationshipType": "RELATED", "storeNodeIds": False} | (config or {})
    lines = spark.read.text(path)
    begun = lambda: F.size(F.split("value", r"<(?:node|edge)\b", -1)) - 1
    found = lines.agg(F.sum(begun()).alias("n"), F.sum(F.col("value").rlike(_ELEMENT).cast("int")).alias("whole"), F.max(begun()).alias("most"), F.max(F.col("value").rlike("<!ENTITY|<!DOCTYPE").cast("int")).alias("odd")).first()
    if found["odd"]:
        raise ValueError("document types and entities are not read")
    if found["n"] == found["whole"] and (found["most"] or 0) <= 1:
        declared = [ET.fromstring(r.value.strip()) for r in lines.filter(F.col("value").rlike(r"^\s*<key\b.*/>\s*$")).collect()]  # property names, not rows
        names = {k.get("id"): k.get("attr.name", k.get("id")) for k in declared}

        def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([row for v in f["value"] for row in _elements(ET.fromstring(v.strip()), names, c)], columns=[x.split()[0] for x in _GRAPHML.split(", ")])

        rows = lines.filter(F.col("value").rlike(_ELEMENT)).mapInPandas(parse, _GRAPHML)
    else:
        root = ET.fromstring("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one document
        names = {k.get("id"): k.get("attr.name", k.get("id")) for k in root.iter() if re.sub(r"^\{.*\}", "", k.tag) == "key"}
        rows = spark.createDataFrame(list(_elements(root, names, c)), _GRAPHML)
    rows = written(rows, "graphml")
    number = lambda name: F.coalesce(F.when(F.col(name).rlike("^n[0-9]{1,18}$"), F.substring(name, 2, 18).cast("long")), F.xxhash64(name))
    labels = F.filter(F.split("label", ":"), lambda x: x != "") if c["readLabels"] else F.expr("cast(array() as array<string>)")
    v = rows.filter("kind = 'node'").select(number("name").alias("id"), labels.alias("labels"), "props")
    e = rows.filter("kind = 'edge'").select(F.xxhash64("name", "source", "target", "label").alias("id"), number("source").alias("src"), number("target").alias("dst"), F.col("label").alias("type"), "props")
    return PropertyGraph(v, e)


_CREATE_NODE = re.compile(r"CREATE \(n((?::`?[^:` ]+`?)*) \{(.*)\}\);$")
_CREATE_REL = re.compile(r"MATCH \(n:_IMPORT_ID \{_IMPORT_ID: (\d+)\}\) MATCH \(m:_IMPORT_ID \{_IMPORT_ID: (\d+)\}\) CREATE \(n\)-\[:`(.+?)` \{(.*)\}\]->\(m\);$")
_PAIR = re.compile(r"`?([^`:, ]+)`?: ('(?:[^'\\]|\\.)*'|-?[0-9.]+)")


@register("import_util.cypher", kind="batch")
def import_cypher(spark: SparkSession, path: str) -> PropertyGraph:
    """What export_util.cypher_all wrote; other statements raise, as there is no query parser here.  Lines are read by all tasks."""
    schema = "kind string, id long, src long, dst long, labels array<string>, type string, props map<string,string>"

    def props(text: str) -> dict[str, str]:
        return {k: re.sub(r"\\(.)", r"\1", v[1:-1]) if v[0] == "'" else v for k, v in _PAIR.findall(text)}

    def parsed(line: str) -> Iterator[tuple]:
        if m := _CREATE_NODE.match(line):
            own = props(m[2])
            yield "node", int(own.pop("_IMPORT_ID")), None, None, [x.strip("`") for x in m[1].split(":") if x and x.strip("`") != "_IMPORT_ID"], None, own
        elif m := _CREATE_REL.match(line):
            yield "rel", None, int(m[1]), int(m[2]), None, m[3], props(m[4])
        elif line.strip() and not re.match(r"(CREATE INDEX|DROP INDEX|MATCH \(n:_IMPORT_ID\) REMOVE)", line):
            yield "odd", None, None, None, None, line[:80], None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for f in frames:
            out = pd.DataFrame([row for line in f["value"] for row in parsed(line)], columns=names)
            yield out.astype({c: "Int64" for c in ("id", "src", "dst")})

    rows = written(spark.read.text(path).mapInPandas(run, schema), "statements")
    if odd := rows.filter("kind = 'odd'").first():
        raise ValueError(f"not a statement of an exported script: {odd['type']}")
    return PropertyGraph(rows.filter("kind = 'node'").select("id", "labels", "props"), rows.filter("kind = 'rel'").select("src", "dst", "type", "props"))


@register("csv_utils.create_csv_file", kind="batch")
def create_csv_file(filepath: str, content: str, is_append: bool = False) -> str:
    storage.write_text(SparkSession.active(), filepath, content, is_append)
    return filepath


@register("csv_utils.delete_csv_file", kind="batch")
def delete_csv_file(filepath: str) -> None:
    storage.delete(SparkSession.active(), filepath)


class SearchIndex:
    """A search server over REST; every call names what it does."""

    def __init__(self, elastic_url: str, ca_certs: str | None = None, elastic_user: str = "", elastic_password: str = "") -> None:
        self.url, self.ca, self.user, self.password = elastic_url.rstrip("/"), ca_certs, elastic_user, elastic_password

    def request(self, method: str, path: str, body: str | dict | None = None, kind: str = "application/json") -> dict[str, Any]:
        import base64
        import ssl
        from urllib.request import Request, urlopen

        headers = {"Content-Type": kind}
        if self.user:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
        data = body.encode() if isinstance(body, str) else json.dumps(body).encode() if body is not None else None
        context = ssl.create_default_context(cafile=self.ca) if self.url.startswith("https") else None
        with urlopen(Request(f"{self.url}/{path}", data, headers, method=method), context=context) as r:
            return json.loads(r.read() or b"{}")


@register("elastic_search_serialization.connect", kind="batch")
def connect(elastic_url: str, ca_certs: str | None = None, elastic_user: str = "", elastic_password: str = "") -> SearchIndex:
    server = SearchIndex(elastic_url, ca_certs, elastic_user, elastic_password)
    server.request("GET", "")
    return server


@register("elastic_search_serialization.create_index", kind="batch")
def create_index(server: SearchIndex, index_name: str, schema_path: str, schema_parameters: dict | None = None) -> dict:
    spec = json.loads(Path(schema_path).read_text(encoding="utf-8"))
    spec.setdefault("settings", {}).update({k: v for k, v in (schema_parameters or {}).items() if k in ("number_of_shards", "number_of_replicas", "analyzer")})
    return server.request("PUT", index_name, spec)


def bulk(df: DataFrame, server: SearchIndex, index: str, chunk_size: int = 500, max_chunk_bytes: int = 100 << 20) -> None:
    """Send df (id, value: JSON) from its tasks, in requests of bounded size; an id sent again replaces itself."""

    def send(rows) -> None:
        some, size = [], 0

        def flush() -> None:
            found = server.request("POST", "_bulk", "".join(some), "application/x-ndjson")
            if found.get("errors"):
                raise RuntimeError(f"the index refused rows: {str(found)[:300]}")

        for r in rows:
            line = json.dumps({"index": {"_index": index, "_id": r["id"]}}) + "\n" + r["value"] + "\n"
            if some and (len(some) >= chunk_size or size + len(line) > max_chunk_bytes):
                flush()
                some, size = [], 0
            some.append(line)
            size += len(line)
        if some:
            flush()

    df.foreachPartition(send)


@register("elastic_search_serialization.index_db")
def index_db(g: PropertyGraph, server: SearchIndex, node_index: str, edge_index: str, chunk_size: int = 500, max_chunk_bytes: int = 100 << 20) -> DataFrame:
    """(nodes, edges): how many were sent."""
    v = g.V.select("id", F.to_json(F.struct("id", "labels", "props")).alias("value"))
    e = g.E.select("id", F.to_json(F.struct("id", "src", "dst", "type", "props")).alias("value"))
    bulk(v, server, node_index, chunk_size, max_chunk_bytes)
    bulk(e, server, edge_index, chunk_size, max_chunk_bytes)
    return g.spark.createDataFrame([(v.count(), e.count())], "nodes long, edges long")


@register("elastic_search_serialization.index", kind="batch")
def index(changes: DataFrame, server: SearchIndex, node_index: str, edge_index: str, chunk_size: int = 500, max_chunk_bytes: int = 100 << 20) -> DataFrame:
    """changes: kind (vertex or edge), id, value; for foreachBatch of a change stream."""
    for kind, name in (("vertex", node_index), ("edge", edge_index)):
        bulk(changes.filter(F.col("kind") == kind).select("id", "value"), server, name, chunk_size, max_chunk_bytes)
    return changes.groupBy().agg(F.sum((F.col("kind") == "vertex").cast("long")).alias("nodes"), F.sum((F.col("kind") == "edge").cast("long")).alias("edges"))


@register("elastic_search_serialization.reindex", kind="batch")
def reindex(server: SearchIndex, source_index: str, target_index: str, query: dict, chunk_size: int = 500, scroll: str = "5m", op_type: str | None = None) -> dict:
    dest = {"index": target_index} | ({"op_type": op_type} if op_type else {})
    return server.request("POST", f"_reindex?scroll={scroll}", {"source": {"index": source_index, "size": chunk_size, "query": query.get("query", query)}, "dest": dest})


@register("elastic_search_serialization.scan", kind="batch")
def scan(server: SearchIndex, index_name: str, query: dict, scroll: str = "5m", size: int = 1000):
    """Hits, page after page."""
    page = server.request("POST", f"{index_name}/_search?scroll={scroll}&size={size}", query)
    while page.get("hits", {}).get("hits"):
        yield from page["hits"]["hits"]
        page = server.request("POST", "_search/scroll", {"scroll": scroll, "scroll_id": page["_scroll_id"]})


@register("elastic_search_serialization.search", kind="batch")
def search(server: SearchIndex, index_name: str, query: dict, size: int = 1000, from_: int = 0, aggregations: dict | None = None, aggs: dict | None = None) -> dict:
    body = query | ({"aggs": aggregations or aggs} if aggregations or aggs else {})
    return server.request("POST", f"{index_name}/_search?size={size}&from={from_}", body)
