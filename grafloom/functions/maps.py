"""Map functions on map<string, string> columns (flatten: on struct columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import PropertyGraph, prop
from ..registry import function, register
from .collections import _col, _guard


def last_wins(entries: Column) -> Column:
    """A map of an array of (key, value) structs in which the last of equal keys counts, whatever the session's policy is."""
    keys = F.transform(entries, lambda e: e["key"])
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 2, F.size(keys)), x["e"]["key"]))
    return F.map_from_entries(F.transform(kept, lambda x: x["e"]))


@function("map.from_lists")
def from_lists(keys, values) -> Column:
    k, v = _col(keys), _col(values)
    entries = F.transform(F.arrays_zip(k.alias("key"), v.alias("value")), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))
    return _guard((F.size(k) == F.size(v)) & (F.size(k) > 0), last_wins(entries), "lists must be of equal length and not empty")


@function("map.from_pairs")
def from_pairs(pairs) -> Column:
    p = _col(pairs)
    entries = F.transform(p, lambda e: F.struct(F.get(e, F.lit(0)).alias("key"), F.get(e, F.lit(1)).alias("value")))
    return _guard(F.forall(p, lambda e: F.size(e) == 2), last_wins(entries), "every pair must have two values")


@function("map.from_values")
def from_values(values) -> Column:
    v = _col(values)
    entries = F.transform(F.filter(v, lambda x, i: i % 2 == 0), lambda k, i: F.struct(k.cast("string").alias("key"), F.get(v, i * 2 + 1).alias("value")))
    return _guard(F.size(v) % 2 == 0, last_wins(entries), "there must be an even number of values")


@function("map.merge")
def merge(first, second) -> Column:
    """The second's values win; null counts as empty."""
    none = F.expr("cast(map() as map<string,string>)")
    return last_wins(F.concat(F.map_entries(F.coalesce(_col(first), none)), F.map_entries(F.coalesce(_col(second), none))))


@function("map.set_key")
def set_key(m, key, value) -> Column:
    key, value = (x if isinstance(x, Column) else F.lit(x) for x in (key, value))
    return last_wins(F.concat(F.map_entries(_col(m)), F.array(F.struct(key.alias("key"), value.alias("value")))))


@function("map.remove_key")
def remove_key(m, key: str, recursive: bool = False) -> Column:
    return remove_keys(m, [key], recursive)


@function("map.remove_keys")
def remove_keys(m, keys: list[str], recursive: bool = False) -> Column:
    """recursive also goes into nested maps and drops those that become empty (map<string, map<...>>)."""
    out = F.map_filter(_col(m), lambda k, v: ~k.isin(*keys) if keys else F.lit(True))
    if recursive:
        out = F.transform_values(out, lambda k, v: F.map_filter(v, lambda k2, v2: ~k2.isin(*keys)))
        out = F.map_filter(out, lambda k, v: F.size(v) > 0)
    return out


@register("map.flatten", kind="function")
def flatten(df: DataFrame, column: str, delimiter: str = ".") -> Column:
    """A map of a struct column's leaves, keyed by their joined names, as text."""

    def leaves(kind: T.DataType, path: list[str]) -> list[tuple[str, Column]]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(f.dataType, [*path, f.name])]
        return [(delimiter.join(path[1:]), F.col(".".join(f"`{p}`" for p in path)).cast("string"))]

    flat = leaves(df.schema[column].dataType, [column])
    return F.create_map(*[x for k, v in flat for x in (F.lit(k), v)])


@register("map.from_nodes")
def from_nodes(g: PropertyGraph, label: str, property: str) -> DataFrame:  # noqa: A002
    """(key, identity, labels, properties) of the nodes of label that have property; the largest id of equal keys stays.

    A row a key, rather than one map, so that no task gets all nodes.
    """
    v = g.V.filter(F.array_contains("labels", label)).withColumn("key", prop(g.V, property, "string")).filter("key is not null")
    return v.groupBy("key").agg(F.max(F.struct("id", "labels", F.map_entries("props").alias("p"))).alias("m")).select("key", F.col("m.id").alias("identity"), "m.labels", F.map_from_entries("m.p").alias("properties"))
