"""Graph edits as functions from a graph to a graph: create, merge, set_property."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph, prop
from ..registry import register

NO_PROPS = "cast(map() as map<string,string>)"


def text_props(props: dict[str, Any] | None) -> Column:
    """Values become strings; nulls are absent."""
    pairs = [x for k, v in (props or {}).items() if v is not None for x in (F.lit(k), F.lit(str(v)))]
    return F.create_map(*pairs) if pairs else F.expr(NO_PROPS)


def merged(first: Column, second: Column) -> Column:
    """Entries of both maps; the second's count."""
    own = F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(own, second)


def with_vertices(g: PropertyGraph, new: DataFrame) -> PropertyGraph:
    """new: labels and props; ids follow the largest there is."""
    top = g.V.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    new = new if "id" in new.columns else new.withColumn("id", top + F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))
    return PropertyGraph(g.V.unionByName(new, allowMissingColumns=True), g.E)


def with_edges(g: PropertyGraph, new: DataFrame) -> PropertyGraph:
    """new: src, dst, type and maybe props and id.

    Ids are drawn above the largest there is from each row's place, without
    bringing the rows together.
    """
    top = g.E.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    if "id" not in new.columns:
        new = new.withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id())
    if "props" not in new.columns:
        new = new.withColumn("props", F.expr(NO_PROPS))
    return PropertyGraph(g.V, g.E.unionByName(new.select("id", "src", "dst", "type", "props"), allowMissingColumns=True))


def _replace_v(g: PropertyGraph, ids, **columns: Column) -> PropertyGraph:
    """Vertices of ids with columns as given, the others as they are."""
    wanted = g._ids(ids).withColumn("hit_", F.lit(True))
    v = g.V.join(wanted, "id", "left").withColumns({k: F.when(F.col("hit_"), c).otherwise(F.col(k)) for k, c in columns.items()})
    return PropertyGraph(v.select(g.V.columns), g.E)


def _replace_e(g: PropertyGraph, ids, **columns: Column) -> PropertyGraph:
    wanted = g._ids(ids).withColumn("hit_", F.lit(True))
    e = g.E.join(wanted, "id", "left").withColumns({k: F.when(F.col("hit_"), c).otherwise(F.col(k)) for k, c in columns.items()})
    return PropertyGraph(g.V, e.select(g.E.columns))


@register("create.node", kind="write")
def create_node(g: PropertyGraph, label: list[str], props: dict[str, Any]) -> PropertyGraph:
    return create_nodes(g, label, [props])


@register("create.nodes", kind="write")
def create_nodes(g: PropertyGraph, label: list[str], props: list[dict[str, Any]]) -> PropertyGraph:
    rows = [(list(label), {k: str(v) for k, v in p.items() if v is not None}) for p in props]
    return with_vertices(g, g.spark.createDataFrame(rows, "labels array<string>, props map<string,string>"))


@register("create.relationship", kind="write")
def create_relationship(g: PropertyGraph, from_: int, relationshipType: str, properties: dict[str, Any], to: int) -> PropertyGraph:
    row = g.spark.createDataFrame([(from_, to, relationshipType)], "src long, dst long, type string")
    return with_edges(g, row.withColumn("props", text_props(properties)))


@register("create.set_property", kind="write")
def set_property(g: PropertyGraph, nodes, key: str, value: Any) -> PropertyGraph:
    return set_properties(g, nodes, [key], [value])


@register("create.set_properties", kind="write")
def set_properties(g: PropertyGraph, input_nodes, input_keys: list[str], input_values: list[Any]) -> PropertyGraph:
    if len(input_keys) != len(input_values):
        raise ValueError("keys and values differ in length")
    new = dict(zip(input_keys, input_values, strict=True))
    kept = F.map_filter("props", lambda k, v: ~k.isin(*[x for x, y in new.items() if y is None] or [""]))
    return _replace_v(g, input_nodes, props=merged(kept, text_props(new)))


@register("create.remove_properties", kind="write")
def remove_properties(g: PropertyGraph, nodes, keys: list[str]) -> PropertyGraph:
    return _replace_v(g, nodes, props=F.map_filter("props", lambda k, v: ~k.isin(*keys)))


@register("create.remove_labels", kind="write")
def remove_labels(g: PropertyGraph, nodes, label: list[str]) -> PropertyGraph:
    return _replace_v(g, nodes, labels=F.filter("labels", lambda x: ~x.isin(*label)))


@register("create.set_rel_property", kind="write")
def set_rel_property(g: PropertyGraph, input_rel, input_key: str, input_value: Any) -> PropertyGraph:
    return set_rel_properties(g, input_rel, [input_key], [input_value])


@register("create.set_rel_properties", kind="write")
def set_rel_properties(g: PropertyGraph, relationships, keys: list[str], values: list[Any]) -> PropertyGraph:
    if len(keys) != len(values):
        raise ValueError("keys and values differ in length")
    return _replace_e(g, relationships, props=merged(F.col("props"), text_props(dict(zip(keys, values, strict=True)))))


@register("create.remove_rel_properties", kind="write")
def remove_rel_properties(g: PropertyGraph, relationships, keys: list[str]) -> PropertyGraph:
    return _replace_e(g, relationships, props=F.map_filter("props", lambda k, v: ~k.isin(*keys)))


def _has(df: DataFrame, props: dict[str, Any]) -> Column:
    out = F.lit(True)
    for k, v in props.items():
        out = out & prop(df, k, "string").eqNullSafe(F.lit(None if v is None else str(v)))
    return out


@register("merge.node", kind="write")
def merge_node(g: PropertyGraph, labels: list[str], identProps: dict, createProps: dict | None = None, matchProps: dict | None = None) -> PropertyGraph:
    """Nodes that have the labels and identProps get matchProps; if there is none, one is made with identProps and createProps."""
    if any(not x for x in labels):
        raise ValueError("a label is empty")
    hit = F.forall(F.array(*map(F.lit, labels)) if labels else F.expr("cast(array() as array<string>)"), lambda x: F.array_contains("labels", x)) & _has(g.V, identProps)
    if g.V.filter(hit).isEmpty():
        return create_node(g, labels, identProps | (createProps or {}))
    return PropertyGraph(g.V.withColumn("props", F.when(hit, merged(F.col("props"), text_props(matchProps))).otherwise(F.col("props"))), g.E)


@register("merge.relationship", kind="write")
def merge_relationship(g: PropertyGraph, startNode: int, relationshipType: str, identProps: dict, createProps: dict, endNode: int, matchProps: dict | None = None) -> PropertyGraph:
    if not relationshipType:
        raise ValueError("the type is empty")
    hit = (F.col("src") == startNode) & (F.col("dst") == endNode) & (F.col("type") == relationshipType) & _has(g.E, identProps)
    if g.E.filter(hit).isEmpty():
        return create_relationship(g, startNode, relationshipType, identProps | createProps, endNode)
    return PropertyGraph(g.V, g.E.withColumn("props", F.when(hit, merged(F.col("props"), text_props(matchProps))).otherwise(F.col("props"))))


def _copy(g: PropertyGraph, source: int, sourceProperties: list[str], target: int, targetProperties: list[str], from_v: bool, to_v: bool) -> PropertyGraph:
    """Copy by position; absent source properties remove the target's."""
    if len(sourceProperties) != len(targetProperties):
        raise ValueError("the property lists differ in length")
    if not sourceProperties:
        return g
    table = g.V if from_v else g.E
    row = table.filter(F.col("id") == source).select(*[prop(table, k, "string").alias(f"p{i}") for i, k in enumerate(sourceProperties)]).first()
    if row is None:
        raise ValueError("no such source")
    new = dict(zip(targetProperties, row, strict=True))
    gone = [k for k, v in new.items() if v is None]
    kept = F.map_filter("props", lambda k, v: ~k.isin(*gone)) if gone else F.col("props")
    return (_replace_v if to_v else _replace_e)(g, target, props=merged(kept, text_props(new)))


@register("set_property.copyPropertyNode2Node", kind="write")
def copy_node_node(g: PropertyGraph, source: int, sourceProperties: list[str], target: int, targetProperties: list[str]) -> PropertyGraph:
    return _copy(g, source, sourceProperties, target, targetProperties, True, True)


@register("set_property.copyPropertyNode2Rel", kind="write")
def copy_node_rel(g: PropertyGraph, source: int, sourceProperties: list[str], target: int, targetProperties: list[str]) -> PropertyGraph:
    return _copy(g, source, sourceProperties, target, targetProperties, True, False)


@register("set_property.copyPropertyRel2Node", kind="write")
def copy_rel_node(g: PropertyGraph, source: int, sourceProperties: list[str], target: int, targetProperties: list[str]) -> PropertyGraph:
    return _copy(g, source, sourceProperties, target, targetProperties, False, True)


@register("set_property.copyPropertyRel2Rel", kind="write")
def copy_rel_rel(g: PropertyGraph, source: int, sourceProperties: list[str], target: int, targetProperties: list[str]) -> PropertyGraph:
    return _copy(g, source, sourceProperties, target, targetProperties, False, False)


