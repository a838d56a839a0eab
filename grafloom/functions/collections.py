"""List functions: columns of arrays in, columns out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import function, register


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.array(*[F.lit(v) for v in x]) if isinstance(x, list) else F.lit(x)


def _guard(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


@function("collections.sum")
def sum_(numbers) -> Column:
    """Sum as a double; 0 for an empty list."""
    return F.aggregate(_col(numbers), F.lit(0.0), lambda a, v: a + v.cast("double"))


@function("collections.sum_longs")
def sum_longs(numbers) -> Column:
    """Each element is cut to an integer first."""
    return F.aggregate(_col(numbers), F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))


@function("collections.avg")
def avg(numbers) -> Column:
    """NaN for an empty list."""
    c = _col(numbers)
    return F.when(F.size(c) == 0, F.lit(float("nan"))).otherwise(sum_(c) / F.size(c))


@function("collections.min")
def min_(values) -> Column:
    c = _col(values)
    return _guard(F.size(c) > 0, F.array_min(c), "min of an empty list")


@function("collections.max")
def max_(values) -> Column:
    c = _col(values)
    return _guard(F.size(c) > 0, F.array_max(c), "max of an empty list")


@function("collections.sort")
def sort(coll) -> Column:
    return F.array_sort(_col(coll))


@function("collections.contains", "collections.contains_sorted")
def contains(coll, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.exists(_col(coll), lambda v: v.eqNullSafe(value))


@function("collections.contains_all")
def contains_all(coll, values) -> Column:
    c = _col(coll)
    return F.forall(_col(values), lambda v: F.exists(c, lambda x: x.eqNullSafe(v)))


@function("collections.union")
def union(first, second) -> Column:
    return F.array_union(_col(first), _col(second))


@function("collections.union_all")
def union_all(first, second) -> Column:
    return F.concat(_col(first), _col(second))


@function("collections.intersection")
def intersection(first, second) -> Column:
    return F.array_intersect(_col(first), _col(second))


@function("collections.remove_all")
def remove_all(first, second) -> Column:
    """What is left keeps its repetitions."""
    b = _col(second)
    return F.filter(_col(first), lambda v: ~F.exists(b, lambda x: x.eqNullSafe(v)))


@function("collections.to_set")
def to_set(values) -> Column:
    return F.array_distinct(_col(values))


@function("collections.pairs")
def pairs(values) -> Column:
    """[v, next] for each v; the last one's next is null."""
    c = _col(values)
    return F.transform(c, lambda v, i: F.array(v, F.get(c, i + 1)))


@function("collections.flatten")
def flatten(values, depth: int = 1) -> Column:
    """depth levels of nesting are taken out (a column's type tells how many it has); nulls are dropped."""
    c = _col(values)
    for _ in range(depth):
        c = F.flatten(F.filter(c, lambda v: v.isNotNull()))
    return F.filter(c, lambda v: v.isNotNull())


@function("collections.frequencies_as_map")
def frequencies_as_map(coll) -> Column:
    """How often each value, as text, occurs."""
    text = F.transform(_col(coll), lambda v: F.coalesce(v.cast("string"), F.lit("null")))
    return F.map_from_entries(F.transform(F.array_distinct(text), lambda v: F.struct(v.alias("key"), F.size(F.filter(text, lambda x: x == v)).cast("long").alias("value"))))


def split_column(coll, delimiter) -> Column:
    """Runs between delimiters, empty ones left out; an empty list gives one empty run."""
    c = _col(coll)
    delimiter = delimiter if isinstance(delimiter, Column) else F.lit(delimiter)
    at = F.filter(F.transform(c, lambda v, i: F.when(v.eqNullSafe(delimiter), i)), lambda v: v.isNotNull())
    starts, ends = F.concat(F.array(F.lit(0)), F.transform(at, lambda v: v + 1)), F.concat(at, F.array(F.size(c)))
    runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice(c, r["a"] + 1, r["b"] - r["a"]))
    return F.when(F.size(c) == 0, F.array(c)).otherwise(F.filter(runs, lambda r: F.size(r) > 0))


@register("collections.split", kind="function")
def split(df: DataFrame, coll, delimiter) -> DataFrame:
    """(splitted): a row for each run."""
    return df.select(F.explode(split_column(coll, delimiter)).alias("splitted"))


def partition_column(values, size) -> Column:
    c = _col(values)
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(F.size(c) == 0, F.slice(F.array(c), 1, 0)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1)), size), lambda i: F.slice(c, i, size)))


@register("collections.partition", kind="function")
def partition(df: DataFrame, values, partition_size) -> DataFrame:
    """(result): a row for each chunk; the last may be shorter."""
    return df.select(F.explode(partition_column(values, partition_size)).alias("result"))
