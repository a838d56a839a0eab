"""Predicates and facts about nodes' relationships, and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.filters import relationship_rules, steps
from ..registry import function, register


def _incident(g: PropertyGraph, nodes) -> DataFrame:
    """(node, type, dir, other): dir 1 incoming, 2 outgoing."""
    ids = g._ids(nodes)
    out = g.E.select(F.col("src").alias("node"), "type", F.lit(2).alias("dir"), F.col("dst").alias("other"))
    into = g.E.select(F.col("dst").alias("node"), "type", F.lit(1).alias("dir"), F.col("src").alias("other"))
    return out.union(into).join(ids.withColumnRenamed("id", "node"), "node", "left_semi")


def _matches(pattern: str) -> Column:
    r = relationship_rules([pattern], allow_both=False)
    out = F.lit(True) if r.any_out else F.col("type").isin(*r.out) if r.out else F.lit(False)
    into = F.lit(True) if r.any_in else F.col("type").isin(*r.into) if r.into else F.lit(False)
    return ((F.col("dir") == 2) & out) | ((F.col("dir") == 1) & into)


@register("node.relationship_exists")
def relationship_exists(g: PropertyGraph, node: int, pattern: list[str]) -> DataFrame:
    """(exists): whether any relationship of node matches any pattern."""
    own = steps(g, pattern, allow_both=False).filter(F.col("src") == node)
    return own.agg((F.count(F.lit(1)) > 0).alias("exists"))


@register("nodes.relationships_exist")
def nodes_relationships_exist(g: PropertyGraph, nodes, relationships: list[str]) -> DataFrame:
    """(node, result: map of pattern to whether it matches)."""
    if not relationships or (isinstance(nodes, list) and not nodes):
        raise ValueError("there must be nodes and relationships")
    flags = [F.coalesce(F.max(_matches(p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(relationships)]
    found = _incident(g, nodes).groupBy("node").agg(*flags)
    every = g._ids(nodes).withColumnRenamed("id", "node").join(found, "node", "left")
    return every.select("node", F.create_map(*[x for i, p in enumerate(relationships) for x in (F.lit(p), F.coalesce(f"p{i}", F.lit(False)))]).alias("result"))


@register("node.relationships_exist")
def relationships_exist(g: PropertyGraph, node: int, relationships: list[str]) -> DataFrame:
    """(result: map of pattern to whether it matches)."""
    return nodes_relationships_exist(g, [node], relationships).select("result")


@register("nodes.relationship_types")
def nodes_relationship_types(g: PropertyGraph, nodes, types: list[str] | None = None) -> DataFrame:
    """(node, types): the distinct types of each node's relationships that types allow, sorted."""
    found = _incident(g, nodes)
    if types:
        keep = F.lit(False)
        for t in types:
            keep = keep | _matches(t)
        found = found.filter(keep)
    lists = found.groupBy("node").agg(F.array_sort(F.collect_set("type")).alias("types"))
    return g._ids(nodes).withColumnRenamed("id", "node").join(lists, "node", "left").select("node", F.coalesce("types", F.expr("cast(array() as array<string>)")).alias("types"))


@register("node.relationship_types")
def relationship_types(g: PropertyGraph, node: int, types: list[str] | None = None) -> DataFrame:
    return nodes_relationship_types(g, [node], types).select(F.col("types").alias("relationship_types"))


def _degree(g: PropertyGraph, end: str, nodes, type_: str) -> DataFrame:
    e = g.E.filter(F.col("type") == type_) if type_ else g.E
    ids = g.V.select("id") if nodes is None else g._ids(nodes)
    n = e.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return ids.join(n, "id", "left").select(F.col("id").alias("node"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


@register("node.degree_in")
def degree_in(g: PropertyGraph, node=None, type: str = "") -> DataFrame:  # noqa: A002
    """(node, degree), for all nodes unless given."""
    return _degree(g, "dst", node, type)


@register("node.degree_out")
def degree_out(g: PropertyGraph, node=None, type: str = "") -> DataFrame:  # noqa: A002
    return _degree(g, "src", node, type)


@function("label.exists")
def label_exists(labels: Column, label: str) -> Column:
    """False for what has no labels."""
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


@register("nodes.link", kind="write")
def link(g: PropertyGraph, nodes: list[int], type: str) -> PropertyGraph:  # noqa: A002
    """The graph with an edge from each of nodes to the next."""
    if len(nodes) < 2:
        raise ValueError("at least two nodes can be linked")
    from .paths import chain_nodes

    return chain_nodes(g, nodes, type)


@register("nodes.delete", kind="write")
def delete(g: PropertyGraph, nodes) -> PropertyGraph:
    """The graph without nodes and their edges."""
    ids = g._ids(nodes)
    e = g.E.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return PropertyGraph(g.V.join(ids, "id", "left_anti"), e.select(g.E.columns))
