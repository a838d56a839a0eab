"""Refactorings: functions from a graph to a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph, prop
from ..registry import register
from .writes import NO_PROPS, _replace_e, _replace_v, with_edges


@register("refactor.from", kind="write")
def from_(g: PropertyGraph, relationship, new_from: int) -> PropertyGraph:
    return _replace_e(g, relationship, src=F.lit(new_from).cast("long"))


@register("refactor.to", kind="write")
def to(g: PropertyGraph, relationship, new_to: int) -> PropertyGraph:
    return _replace_e(g, relationship, dst=F.lit(new_to).cast("long"))


@register("refactor.invert", kind="write")
def invert(g: PropertyGraph, relationship) -> PropertyGraph:
    hit = g._ids(relationship).withColumn("hit_", F.lit(True))
    e = g.E.join(hit, "id", "left")
    a, b = F.when(F.col("hit_"), F.col("dst")).otherwise(F.col("src")), F.when(F.col("hit_"), F.col("src")).otherwise(F.col("dst"))
    return PropertyGraph(g.V, e.withColumns({"src": a, "dst": b}).select(g.E.columns))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _scope(df: DataFrame, g: PropertyGraph, ids) -> DataFrame:
    return df if ids is None else df.join(g._ids(ids), "id", "left_semi")


@register("refactor.rename_label", kind="write")
def rename_label(g: PropertyGraph, old_label: str, new_label: str, nodes=None) -> PropertyGraph:
    hit = _scope(g.V, g, nodes).filter(F.array_contains("labels", old_label)).select("id")
    return _replace_v(g, hit, labels=F.array_distinct(F.transform("labels", lambda x: F.when(x == old_label, F.lit(new_label)).otherwise(x))))


@register("refactor.rename_label_count")
def rename_label_count(g: PropertyGraph, old_label: str, new_label: str, nodes=None) -> DataFrame:
    """(nodes_changed) by rename_label."""
    return _count(_scope(g.V, g, nodes).filter(F.array_contains("labels", old_label)), "nodes_changed")


def _renamed(old: str, new: str) -> Column:
    moved = F.map_from_entries(F.transform(F.filter(F.map_entries("props"), lambda e: e["key"] != new), lambda e: F.struct(F.when(e["key"] == old, F.lit(new)).otherwise(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.when(F.map_contains_key("props", old), moved).otherwise(F.col("props"))


@register("refactor.rename_node_property", kind="write")
def rename_node_property(g: PropertyGraph, old_property: str, new_property: str, nodes=None) -> PropertyGraph:
    return _replace_v(g, _scope(g.V, g, nodes).select("id"), props=_renamed(old_property, new_property))


@register("refactor.rename_type", kind="write")
def rename_type(g: PropertyGraph, oldType: str, newType: str, rels=None) -> PropertyGraph:
    return _replace_e(g, _scope(g.E, g, rels).filter(F.col("type") == oldType).select("id"), type=F.lit(newType))


@register("refactor.rename_type_property", kind="write")
def rename_type_property(g: PropertyGraph, old_property: str, new_property: str, rels=None) -> PropertyGraph:
    return _replace_e(g, _scope(g.E, g, rels).select("id"), props=_renamed(old_property, new_property))


@register("refactor.categorize", kind="write")
def categorize(g: PropertyGraph, original_prop_key: str, rel_type: str, is_outgoing: bool, new_label: str, new_prop_name_key: str, copy_props_list: list[str] | None = None) -> PropertyGraph:
    """A node for each distinct value of a property, linked with all that have it; the property goes from those."""
    value = prop(g.V, original_prop_key, "string")
    top = g.V.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    copied = [c for c in (copy_props_list or []) if c != original_prop_key]
    holders = g.V.withColumn("value_", value).filter("value_ is not null")
    values = holders.groupBy("value_").agg(*[F.max(prop(holders, c, "string")).alias(f"c_{i}") for i, c in enumerate(copied)], F.count(F.lit(1)).alias("n_"))
    entries = F.array(F.struct(F.lit(new_prop_name_key).alias("key"), F.col("value_").alias("value")), *[F.struct(F.lit(c).alias("key"), F.col(f"c_{i}").alias("value")) for i, c in enumerate(copied)])
    fresh = values.withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id()).withColumn("props", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))).withColumn("labels", F.array(F.lit(new_label)))
    from ..plans.lineage import written

    fresh = written(fresh.select("id", "labels", "props", "value_"), "categories")
    pairs = holders.select("id", "value_").join(fresh.select(F.col("id").alias("c"), "value_"), "value_")
    ends = pairs.select(F.col("id").alias("src"), F.col("c").alias("dst")) if is_outgoing else pairs.select(F.col("c").alias("src"), F.col("id").alias("dst"))
    gone = [original_prop_key, *copied]
    v = g.V.withColumn("props", F.when(value.isNotNull(), F.map_filter("props", lambda k, x: ~k.isin(*gone))).otherwise(F.col("props")))
    return with_edges(PropertyGraph(v.unionByName(fresh.drop("value_"), allowMissingColumns=True), g.E), ends.withColumn("type", F.lit(rel_type)))


def _fresh_ids(df: DataFrame, top: int) -> DataFrame:
    from ..plans.lineage import written

    return written(df.withColumn("new", F.lit(top + 1) + F.monotonically_increasing_id()), "clones")


def _tops(g: PropertyGraph) -> tuple[int, int]:
    return g.V.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0], g.E.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]


@register("refactor.clone_nodes", kind="write")
def clone_nodes(g: PropertyGraph, nodes, withRelationships: bool = False, skipProperties: list[str] | None = None) -> PropertyGraph:
    """Copies of nodes; with relationships, copies of theirs too, without properties."""
    vtop, _ = _tops(g)
    clones = _fresh_ids(g._ids(nodes), vtop)
    v = g.V.join(clones, "id").withColumn("id", F.col("new")).drop("new")
    if skipProperties:
        v = v.withColumn("props", F.map_filter("props", lambda k, x: ~k.isin(*skipProperties)))
    out = PropertyGraph(g.V.unionByName(v.select(g.V.columns)), g.E)
    if not withRelationships:
        return out
    a = g.E.join(clones.withColumnRenamed("id", "src"), "src").select(F.col("new").alias("src"), "dst", "type")
    b = g.E.join(clones.withColumnRenamed("id", "dst"), "dst").select("src", F.col("new").alias("dst"), "type")
    return with_edges(out, a.union(b))


@register("refactor.clone_subgraph", kind="write")
def clone_subgraph(g: PropertyGraph, nodes, rels=None, config: dict | None = None) -> PropertyGraph:
    """Copies of nodes and of rels among them (all, unless given); standinNodes take the place of copies."""
    c = config or {}
    standin = {int(a): int(b) for a, b in c.get("standinNodes", [])}
    skip = c.get("skipProperties", [])
    vtop, _ = _tops(g)
    wanted = g._ids(nodes)
    clones = _fresh_ids(wanted.filter(~F.col("id").isin(*standin)) if standin else wanted, vtop)
    v = g.V.join(clones, "id").withColumn("id", F.col("new")).drop("new")
    if skip:
        v = v.withColumn("props", F.map_filter("props", lambda k, x: ~k.isin(*skip)))
    image = clones.select("id", "new")
    if standin:
        image = image.union(g.spark.createDataFrame(list(standin.items()), "id long, new long"))
    e = g.E if not rels else g.E.join(g._ids(rels), "id", "left_semi")
    e = e.join(image.select(F.col("id").alias("src"), F.col("new").alias("a")), "src").join(image.select(F.col("id").alias("dst"), F.col("new").alias("b")), "dst")
    return with_edges(PropertyGraph(g.V.unionByName(v.select(g.V.columns)), g.E), e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", "props"))


@register("refactor.clone_subgraph_from_paths", kind="write")
def clone_subgraph_from_paths(g: PropertyGraph, paths: DataFrame, config: dict | None = None) -> PropertyGraph:
    """paths: a column of path structs."""
    p = paths.columns[0]
    nodes, rels = paths.select(F.explode(f"{p}.nodes").alias("id")), paths.select(F.explode(f"{p}.rels").alias("id"))
    return clone_subgraph(g, nodes, rels, config)


@register("refactor.collapse_node", kind="write")
def collapse_node(g: PropertyGraph, nodes, type: str) -> PropertyGraph:  # noqa: A002
    """A node with one edge in and one out becomes an edge between the others, with its properties; others raise."""
    ids = g._ids(nodes)
    into = g.E.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("a"))
    out = g.E.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("b"))
    both = ids.join(into, "id", "left").join(out, "id", "left")
    if not both.filter("i is null or o is null or i <> 1 or o <> 1 or a = id").isEmpty():
        raise ValueError("a node to collapse must have one edge in and one out, and no self-loop")
    new = both.join(g.V.select("id", "props"), "id").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(type).alias("type"), "props")
    from .nodes import delete

    return delete(with_edges(g, new), nodes)


@register("refactor.extract_node", kind="write")
def extract_node(g: PropertyGraph, relationships, labels: list[str], outType: str, inType: str) -> PropertyGraph:
    """Each edge becomes a node with its properties, an edge from its source and one to its target."""
    vtop, _ = _tops(g)
    chosen = _fresh_ids(g.E.join(g._ids(relationships), "id", "left_semi").select("id", "src", "dst", "props"), vtop)
    label = F.array(*map(F.lit, labels)) if labels else F.expr("cast(array() as array<string>)")
    v = g.V.unionByName(chosen.select(F.col("new").alias("id"), label.alias("labels"), "props"), allowMissingColumns=True)
    e = g.E.join(chosen.select("id"), "id", "left_anti")
    new = chosen.select("src", F.col("new").alias("dst"), F.lit(inType).alias("type")).union(chosen.select(F.col("new"), "dst", F.lit(outType)))
    return with_edges(PropertyGraph(v, e.select(g.E.columns)), new)


@register("refactor.delete_and_reconnect", kind="write")
def delete_and_reconnect(g: PropertyGraph, path: dict, nodes: list[int], config: dict | None = None) -> PropertyGraph:
    """path: nodes and rels (ids).  Nodes go from it, and an edge joins the ends of each gap: like the edge before the gap
    (incoming, the default), after it (outgoing), or both (merge: types joined, properties by combine, discard or override)."""
    c = {"relationshipSelectionStrategy": "incoming", "properties": "combine"} | (config or {})
    how = c["relationshipSelectionStrategy"]
    if how not in ("incoming", "outgoing", "merge") or c["properties"] not in ("combine", "discard", "override"):
        raise ValueError("the strategy is incoming, outgoing or merge, and properties combine, discard or override")
    rels = {r["id"]: r for r in g.E.filter(F.col("id").isin(*path["rels"])).select("id", "type", "props", "src").collect()} if path["rels"] else {}  # of one path
    gone, new, last = set(nodes), [], None
    for i, n in enumerate(path["nodes"]):
        if n in gone:
            continue
        if last is not None and i - last > 1:
            a, b = rels[path["rels"][last]], rels[path["rels"][i - 1]]
            p, q = dict(a["props"] or {}), dict(b["props"] or {})
            if how == "merge":
                kind = f"{a['type']}_{b['type']}"
                both = {k: f"[{p[k]},{q[k]}]" if c["properties"] == "combine" and k in p and k in q and p[k] != q[k] else (p | q)[k] if c["properties"] != "discard" else (q | p)[k] for k in p | q}
                new.append((path["nodes"][last], n, kind, both))
            else:
                one = a if how == "incoming" else b
                new.append((path["nodes"][last], n, one["type"], dict(one["props"] or {})))
        last = i
    from .nodes import delete

    made = with_edges(g, g.spark.createDataFrame(new, "src long, dst long, type string, props map<string,string>")) if new else g
    return delete(made, list(nodes)) if nodes else made


@register("refactor.normalize_as_boolean", kind="write")
def normalize_as_boolean(g: PropertyGraph, entity, property_key: str, true_values: list, false_values: list, edges: bool = False) -> PropertyGraph:
    """true, false, or no property where the value is in neither list."""
    yes, no = [str(x) for x in true_values], [str(x) for x in false_values]
    if set(yes) & set(no):
        raise ValueError("a value is in both lists")
    value = F.col("props")[property_key]
    rest = F.map_filter("props", lambda k, v: k != property_key)
    put = lambda x: F.map_concat(rest, F.create_map(F.lit(property_key), F.lit(x)))
    props = F.when(value.isin(*yes) if yes else F.lit(False), put("true")).when(value.isin(*no) if no else F.lit(False), put("false")).otherwise(rest)
    return (_replace_e if edges else _replace_v)(g, entity, props=props)


@register("refactor.merge_nodes", kind="write")
def merge_nodes(g: PropertyGraph, nodes: list[int], config: dict | None = None) -> PropertyGraph:
    """Fold nodes into the first: all labels; properties combine (lists of distinct values), discard (the first's count) or
    override (the last's); edges are re-pointed with mergeRels, else they go."""
    c = {"properties": "combine", "mergeRels": False} | (config or {})
    how = {"overwrite": "override"}.get(c["properties"], c["properties"])
    if not nodes or how not in ("combine", "discard", "override"):
        raise ValueError("give nodes, and combine, discard or override for properties")
    first, order = nodes[0], g.spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(nodes))], "id long, i int")
    held = g.V.select("id", "labels", "props").join(F.broadcast(order), "id")
    keyed = held.select("i", F.explode("props").alias("key", "value")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("vs"))
    distinct = F.array_distinct(F.transform("vs", lambda x: x["value"]))
    value = {"discard": F.get("vs", F.lit(0))["value"], "override": F.element_at("vs", -1)["value"], "combine": F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(distinct, ","), F.lit("]")))}[how]
    props = keyed.agg(F.map_from_entries(F.collect_list(F.struct("key", value.alias("value")))).alias("merged_props"))
    labels = held.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("merged_labels"))
    rest = [n for n in nodes[1:] if n != first]
    v = g.V.filter(~F.col("id").isin(*rest)) if rest else g.V
    v = v.crossJoin(F.broadcast(props)).crossJoin(F.broadcast(labels))  # one row each
    v = v.withColumns({"props": F.when(F.col("id") == first, F.coalesce("merged_props", F.expr(NO_PROPS))).otherwise(F.col("props")), "labels": F.when(F.col("id") == first, F.col("merged_labels")).otherwise(F.col("labels"))})
    e = g.E
    if rest:
        hit = F.col("src").isin(*rest) | F.col("dst").isin(*rest)
        if c["mergeRels"]:
            moved = lambda x: F.when(F.col(x).isin(*rest), F.lit(first)).otherwise(F.col(x))
            e = e.withColumns({"props": F.when(hit, F.expr(NO_PROPS)).otherwise(F.col("props")), "src": moved("src"), "dst": moved("dst")})
        else:
            e = e.filter(~hit)
    return PropertyGraph(v.select(g.V.columns), e.select(g.E.columns))
