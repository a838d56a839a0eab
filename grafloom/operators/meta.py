"""Metadata, analyses, schemas, and control of nested work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.lineage import written
from ..plans.loops import components
from ..registry import register
from . import nxalg
from .structure import scc, strong_labels


def _counted(df: DataFrame, key, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("kind"), key.cast("string").alias("key")).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def stats_rows(g: PropertyGraph) -> DataFrame:
    """(kind, key, n): counts of labels, types, property keys, patterns, nodes and relationships, each from one pass."""
    ends = g.E.select("type", "src", "dst")
    labels = g.V.select("id", F.explode("labels").alias("label"))
    keys = g.V.select(F.explode(F.map_keys("props")).alias("k")).union(g.E.select(F.explode(F.map_keys("props"))))
    out = [
        _counted(g.V, F.lit("nodes"), "node"), _counted(g.E, F.lit("relationships"), "relationship"), _counted(labels, F.col("label"), "label"), _counted(g.E, F.col("type"), "type"), _counted(keys, F.col("k"), "property"),
        _counted(ends, F.concat(F.lit("()-[:"), F.col("type"), F.lit("]->()")), "pattern"),
        _counted(ends.join(labels.withColumnRenamed("id", "src"), "src"), F.concat(F.lit("(:"), F.col("label"), F.lit(")-[:"), F.col("type"), F.lit("]->()")), "pattern"),
        _counted(ends.join(labels.withColumnRenamed("id", "dst"), "dst"), F.concat(F.lit("()-[:"), F.col("type"), F.lit("]->(:"), F.col("label"), F.lit(")")), "pattern"),
    ]
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found


def stats_of(rows: DataFrame) -> DataFrame:
    """One row of counts and maps from (kind, key, n)."""
    pick = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    many = lambda kind: F.count(F.when(F.col("kind") == kind, True))
    return rows.filter("n <> 0").agg(
        many("label").alias("labelCount"), many("type").alias("relationshipTypeCount"), many("property").alias("propertyKeyCount"), total("node").alias("nodeCount"), total("relationship").alias("relationshipCount"),
        pick("label").alias("labels"), pick("pattern").alias("relationshipTypes"), pick("type").alias("relationshipTypesCount"),
    )


@register("meta.stats_offline")
def stats_offline(g: PropertyGraph) -> DataFrame:
    return stats_of(stats_rows(g))


def _sorted_labels():
    return F.array_sort("labels")


@register("meta_util.schema")
def schema(g: PropertyGraph, include_properties: bool = False) -> DataFrame:
    """(kind, start, type, end, count, properties: how many have each key): nodes by label set, relationships by ends' label sets."""
    if g.V.isEmpty():
        raise ValueError("the graph is empty")
    lab = g.V.select("id", _sorted_labels().alias("l"))
    nodes = g.V.select(_sorted_labels().alias("start"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("array<string>").alias("end"), F.map_keys("props").alias("k"))
    rels = g.E.join(lab.select(F.col("id").alias("src"), F.col("l").alias("start")), "src").join(lab.select(F.col("id").alias("dst"), F.col("l").alias("end")), "dst").select("start", "type", "end", F.map_keys("props").alias("k"))
    every = nodes.withColumn("kind", F.lit("node")).union(rels.withColumn("kind", F.lit("relationship")))
    by = ["kind", "start", "type", "end"]
    counts = every.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    if not include_properties:
        return counts
    keys = every.select(*by, F.explode("k").alias("key")).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("properties"))
    same = [counts[c].eqNullSafe(keys[c]) for c in by]
    return counts.join(keys, same, "left").select(*[counts[c] for c in by], "count", "properties")


@register("llm_util.schema")
def prompt_schema(g: PropertyGraph, output_type: str = "prompt_ready") -> DataFrame:
    """(schema): text for a prompt, or with raw a row (kind, name, property, type) for each fact."""
    if output_type.lower() not in ("prompt_ready", "raw"):
        raise ValueError("output_type is prompt_ready or raw")
    if g.V.isEmpty():
        raise ValueError("the graph is empty")
    kind_of = F.when(F.col("v").rlike("^-?[0-9]+$"), "int").when(F.col("v").rlike(r"^-?[0-9]*\.[0-9]+([eE][+-]?[0-9]+)?$"), "float").when(F.lower("v").isin("true", "false"), "bool").otherwise("str")
    n = g.V.select(F.explode("labels").alias("name"), "props").select("name", F.explode_outer("props").alias("property", "v"))
    r = g.E.select(F.col("type").alias("name"), "props").select("name", F.explode_outer("props").alias("property", "v"))
    lab = g.V.select("id", F.explode("labels").alias("l"))
    ends = g.E.join(lab.select(F.col("id").alias("src"), F.col("l").alias("a")), "src").join(lab.select(F.col("id").alias("dst"), F.col("l").alias("b")), "dst")
    facts = n.select(F.lit("node").alias("kind"), "name", "property", F.when(F.col("v").isNotNull(), kind_of).alias("type")).union(r.select(F.lit("relationship"), "name", "property", F.when(F.col("v").isNotNull(), kind_of)))
    facts = facts.union(ends.select(F.lit("pattern"), F.concat(F.lit("(:"), "a", F.lit(")-[:"), "type", F.lit("]->(:"), "b", F.lit(")")), F.lit(None), F.lit(None))).distinct()
    if output_type.lower() == "raw":
        return facts
    named = facts.groupBy("kind", "name").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "property", F.lit(": "), "type"))), "\n").alias("p"))
    lines = F.concat("name", F.when(F.length("p") > 0, F.concat(F.lit("\n"), F.col("p"))).otherwise(F.lit("")))
    text = named.agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, lines))), "\n").alias(k) for k in ("node", "relationship", "pattern")])
    return text.select(F.concat(F.lit("Nodes and their properties:\n"), "node", F.lit("\nRelationships and their properties:\n"), "relationship", F.lit("\nThe relationships:\n"), "pattern").alias("schema"))


FIRST = 10


def _list(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(column).limit(FIRST).agg(F.to_json(F.collect_list(column)).alias("value"))


def _analyses() -> dict[str, Callable[[PropertyGraph], DataFrame]]:
    value = lambda df: df.select(F.col(df.columns[0]).cast("string").alias("value"))
    own = lambda g, e: g.spark.createDataFrame([(str(e),)], "value string")
    deg = lambda g: g.V.select("id").join(g.undirected().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left").fillna(0, ["d"])
    wcc = lambda g: written(components(g.V, g.E), "wcc")
    from .structure import bridges, is_bipartite, biconnected

    return {
        "nodes": lambda g: value(g.V.agg(F.count(F.lit(1)))), "edges": lambda g: value(g.E.agg(F.count(F.lit(1)))),
        "bridges": lambda g: value(bridges(g).agg(F.count(F.lit(1)))),
        "articulation_points": lambda g: value(biconnected(g).select("bcc_id", F.explode(F.array("node_from", "node_to")).alias("n")).distinct().groupBy("n").count().filter("count > 1").agg(F.count(F.lit(1)))),
        "avg_degree": lambda g: value(deg(g).agg(F.avg("d"))), "sorted_nodes_degree": lambda g: deg(g).orderBy(F.desc("d"), "id").limit(FIRST).agg(F.to_json(F.collect_list(F.array("id", "d"))).alias("value")),
        "self_loops": lambda g: value(g.E.filter("src = dst").agg(F.count(F.lit(1)))),
        "is_bipartite": lambda g: value(is_bipartite(g)), "is_planar": lambda g: value(nxalg.check_planarity(g)),
        "is_biconnected": lambda g: own(g, biconnected(g).select("bcc_id").distinct().limit(2).count() == 1 and wcc(g).select("component").distinct().limit(2).count() == 1),
        "is_weakly_connected": lambda g: own(g, wcc(g).select("component").distinct().limit(2).count() == 1),
        "number_of_weakly_components": lambda g: value(wcc(g).agg(F.count_distinct("component"))),
        "is_strongly_connected": lambda g: own(g, scc(g).limit(2).count() == 1), "strongly_components": lambda g: value(scc(g).agg(F.count(F.lit(1)))),
        "is_dag": lambda g: own(g, strong_labels(g).groupBy("label").count().filter("count > 1").isEmpty() and g.E.filter("src = dst").isEmpty()),
        "is_eulerian": lambda g: value(nxalg.is_eulerian(g)), "is_forest": lambda g: value(nxalg.is_forest(g)), "is_tree": lambda g: value(nxalg.is_tree(g)),
    }


@register("graph_analyzer.help")
def analyzer_help(g: PropertyGraph) -> DataFrame:
    return g.spark.createDataFrame([(k, "an analysis that analyze takes by this name") for k in _analyses()], "name string, value string")


@register("graph_analyzer.analyze")
def analyze(g: PropertyGraph, analyses: list[str] | None = None) -> DataFrame:
    """(name, value): named analyses, all unless given; lists stop at ten."""
    known = _analyses()
    wrong = set(analyses or []) - set(known)
    if wrong:
        raise ValueError(f"no analysis named {', '.join(sorted(wrong))}")
    out = None
    for name in analyses or known:
        row = known[name](g).select(F.lit(name).alias("name"), "value")
        out = row if out is None else out.union(row)
    return out


@register("graph_analyzer.analyze_subgraph")
def analyze_subgraph(g: PropertyGraph, vertices, edges, analyses: list[str] | None = None) -> DataFrame:
    return analyze(g.subgraph(vertices, edges), analyses)


@register("periodic.iterate")
def iterate(g: PropertyGraph, input_query: Callable[[PropertyGraph], DataFrame], running_query: Callable[[DataFrame, int], None], config: dict) -> DataFrame:
    """(success, number_of_executed_batches): rows of input_query go to running_query in batches of batch_size."""
    size = int(config.get("batch_size", 0))
    if size <= 0:
        raise ValueError("batch_size must be positive")
    rows = written(input_query(g), "rows")
    n = rows.count()
    batches = -(-n // size)
    if batches:
        numbered = written(_numbered(rows), "numbered")
        for b in range(batches):
            running_query(numbered.filter((F.col("row_") >= b * size) & (F.col("row_") < (b + 1) * size)).drop("row_"), b)
    return g.spark.createDataFrame([(True, batches)], "success boolean, number_of_executed_batches long")


def _numbered(df: DataFrame) -> DataFrame:
    """df with consecutive numbers row_, from the partitions' counts, without an order over all rows."""
    placed = written(df.withColumn("p_", F.spark_partition_id()).withColumn("m_", F.monotonically_increasing_id()), "placed")
    counts = sorted((r["p_"], r["n"], r["least"]) for r in placed.groupBy("p_").agg(F.count(F.lit(1)).alias("n"), F.min("m_").alias("least")).collect())
    start, table = 0, []
    for p, n, least in counts:
        table.append((p, start - least))
        start += n
    shift = df.sparkSession.createDataFrame(table, "p_ int, shift_ long")
    return placed.join(F.broadcast(shift), "p_").withColumn("row_", F.col("m_") + F.col("shift_")).drop("p_", "m_", "shift_")  # a row a partition


@register("periodic.delete")
def periodic_delete(g: PropertyGraph, config: dict) -> DataFrame:
    """(success, number_of_executed_batches, number_of_deleted_nodes, number_of_deleted_relationships) of deleted(g, config)."""
    size = int(config.get("batch_size", 0))
    if size <= 0:
        raise ValueError("batch_size must be positive")
    v, e = _doomed(g, config)
    nodes, rels = v.count(), e.count()
    batches = (rels // size + 1 if rels else 0) + (nodes // size + 1 if nodes else 0)
    return g.spark.createDataFrame([(True, batches, nodes, rels)], "success boolean, number_of_executed_batches long, number_of_deleted_nodes long, number_of_deleted_relationships long")


def _doomed(g: PropertyGraph, config: dict) -> tuple[DataFrame, DataFrame]:
    """Nodes that have all labels, and edges of any of edge_types or of those nodes."""
    labels, types = ([x] if isinstance(x, str) else list(x or []) for x in (config.get("labels"), config.get("edge_types")))
    everything = not labels and not types
    v = g.V.filter(F.forall(F.array(*map(F.lit, labels)), lambda x: F.array_contains("labels", x))) if labels else g.V if everything else g.V.limit(0)
    ids = v.select("id")
    own = g.E.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("id").union(g.E.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id"))
    typed = g.E.filter(F.col("type").isin(*types)).select("id") if types else g.E.select("id").limit(0)
    return v, own.union(typed).distinct()


@register("periodic.deleted", kind="write")
def deleted(g: PropertyGraph, config: dict) -> PropertyGraph:
    """The graph after periodic.delete."""
    v, e = _doomed(g, config)
    return PropertyGraph(g.V.join(v.select("id"), "id", "left_anti"), g.E.join(e, "id", "left_anti"))


Query = Callable[[PropertyGraph, dict], DataFrame]


@register("do.when")
def when(g: PropertyGraph, condition: bool, if_query: Query, else_query: Query, params: dict | None = None) -> DataFrame:
    return (if_query if condition else else_query)(g, params or {})


@register("do.case")
def case(g: PropertyGraph, conditionals: list, else_query: Query, params: dict | None = None) -> DataFrame:
    """conditionals: condition, query, condition, query, ...; the first true one counts."""
    if not conditionals or len(conditionals) % 2:
        raise ValueError("conditionals are pairs of a condition and a query")
    for condition, query in zip(conditionals[::2], conditionals[1::2], strict=True):
        if condition:
            return query(g, params or {})
    return else_query(g, params or {})


@register("rust_example.basic")
def basic(g: PropertyGraph, input_string: str, optional_input_int: int = 0) -> DataFrame:
    return g.spark.createDataFrame([(input_string, optional_input_int)], "output_string string, output_int long")


@register("rust_example.test_procedure")
def test_procedure(g: PropertyGraph) -> DataFrame:
    """Facts of each vertex: labels, name, properties sorted by key, and the type of its first edge out."""
    first = g.E.groupBy(F.col("src").alias("id")).agg(F.min_by("type", "id").alias("first_edge_type"))
    pairs = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return g.V.join(first, "id", "left").select(
        F.size("labels").alias("labels_count"), F.array_contains("labels", "L3").alias("has_L3_label"), F.coalesce(F.get("labels", F.lit(0)), F.lit("")).alias("first_label"),
        F.col("props")["name"].alias("name_property"), F.array_join(pairs, ", ").alias("properties_string"), F.coalesce("first_edge_type", F.lit("")).alias("first_edge_type"), F.array(F.lit(0), F.lit(1)).alias("list"),
    )
