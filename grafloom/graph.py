"""A property graph is two DataFrames: vertices (id, labels, props, ...) and edges (id, src, dst, type, props, ...).

props holds schemaless properties as strings; typed columns beside it take
precedence, so that graphs derived from tables keep their types and Catalyst can
prune and push down.  Parallel edges and self-loops are kept.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import lookup

V_COLUMNS = {"id": "bigint", "labels": "array<string>", "props": "map<string,string>"}
E_COLUMNS = {"id": "bigint", "src": "bigint", "dst": "bigint", "type": "string", "props": "map<string,string>"}
V_SCHEMA = ", ".join(f"{k} {t}" for k, t in V_COLUMNS.items())
E_SCHEMA = ", ".join(f"{k} {t}" for k, t in E_COLUMNS.items())


def prop(df: DataFrame, name: str, kind: str | None = None) -> Column:
    """A property of df's rows: its typed column, else its entry of props; null where absent."""
    found = F.col(f"`{name}`") if name in df.columns and name not in ("id", "labels", "props", "src", "dst", "type") else F.col("props")[name]
    return found.cast(kind) if kind else found


class PropertyGraph:
    def __init__(self, vertices: DataFrame, edges: DataFrame) -> None:
        self.V = self._complete(vertices, V_COLUMNS)
        if "id" not in edges.columns:
            edges = edges.withColumn("id", F.monotonically_increasing_id())
        self.E = self._complete(edges, E_COLUMNS)
        self.spark: SparkSession = vertices.sparkSession

    @staticmethod
    def _complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
        empty = {"labels": "array()", "props": "map()", "type": "'RELATION'"}
        missing = [F.expr(f"cast({empty[c]} as {t})").alias(c) for c, t in columns.items() if c not in df.columns]
        own = [F.col(c).cast(columns[c]).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
        return df.select(*own, *missing)

    @classmethod
    def of(cls, spark: SparkSession, vertices: list, edges: list) -> PropertyGraph:
        """Small graphs from lists: vertices are ids or (id, labels, props), edges (src, dst) or (src, dst, type, props); values become strings."""
        text = lambda props: {k: str(v) for k, v in props.items() if v is not None}
        vs = [(v, [], {}) if isinstance(v, int) else (v[0], list(v[1]), text(v[2] if len(v) > 2 else {})) for v in vertices]
        es = [(i, e[0], e[1], e[2] if len(e) > 2 else "RELATION", text(e[3] if len(e) > 3 else {})) for i, e in enumerate(edges)]
        return cls(spark.createDataFrame(vs, V_SCHEMA), spark.createDataFrame(es, E_SCHEMA))

    def weight(self, name: str | None = "weight", default: float | None = 1.0) -> Column:
        """An edge's weight, or default where it has none."""
        if name is None:
            return F.lit(default if default is not None else 1.0).cast("double")
        w = prop(self.E, name, "double")
        return F.coalesce(w, F.lit(float(default))) if default is not None else w

    def subgraph(self, nodes: list[int] | DataFrame, edges: list[int] | DataFrame | None = None) -> PropertyGraph:
        """Given vertices and those of the given edges (all, if none are) that have both ends among them."""
        ids = self._ids(nodes)
        e = self.E if edges is None else self.E.join(self._ids(edges), "id", "left_semi")
        e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(self.V.join(ids, "id", "left_semi"), e.select(self.E.columns))

    def _ids(self, ids: int | list[int] | DataFrame) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        ids = [ids] if isinstance(ids, int) else ids
        return self.spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")

    def undirected(self) -> DataFrame:
        """Each edge in both directions (id, src, dst, ...); a self-loop twice."""
        return self.E.union(self.E.withColumns({"src": F.col("dst"), "dst": F.col("src")}))

    def call(self, name: str, *args: Any, **kwargs: Any) -> Any:
        entry = lookup(name)
        return entry.call(*args, **kwargs) if entry.kind in ("function", "batch") else entry.call(self, *args, **kwargs)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART = 1_000_000_000


def trade(spark: SparkSession, sf_dir: str, both: bool = False) -> PropertyGraph:
    """Suppliers and the parts they supply (part ids follow PART), weighted by quantity; with both, also part to supplier."""
    from .plans.lineage import ROWS_A_TASK, dealt

    line = load(spark, sf_dir, "lineitem")
    line, rows = line.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"), "l_quantity"), line.count()
    # Few pairs are there twice, so that sums by task before the deal would only cost memory.
    line = dealt(line, rows, "src", "dst") if rows > ROWS_A_TASK else line
    e = line.groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))
    if both:
        e = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    e = e.withColumn("id", F.xxhash64("src", "dst")).withColumn("type", F.lit("SUPPLIES"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.lit("Supplier")).alias("labels"), F.col("s_name").alias("name"))
    p = load(spark, sf_dir, "part").select((F.col("p_partkey") + PART).alias("id"), F.array(F.lit("Part")).alias("labels"), F.col("p_name").alias("name"))
    return PropertyGraph(s.union(p), e)


#: Ids of the geography graph: region r is r, nation n is 100 + n, supplier and customer follow.
NATION, SUPPLIER, CUSTOMER = 100, 1_000_000_000, 2_000_000_000


def geography(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and suppliers in nations, nations in regions."""
    r, n, s, c = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    label = lambda x: F.array(F.lit(x)).alias("labels")
    long = lambda col, shift=0: (F.col(col).cast("long") + shift)
    v = r.select(long("r_regionkey").alias("id"), label("Region"), F.col("r_name").alias("name"))
    v = v.union(n.select(long("n_nationkey", NATION), label("Nation"), "n_name"))
    v = v.union(s.select(long("s_suppkey", SUPPLIER), label("Supplier"), "s_name")).union(c.select(long("c_custkey", CUSTOMER), label("Customer"), "c_name"))
    e = n.select(long("n_nationkey", NATION).alias("src"), long("n_regionkey").alias("dst"), F.lit("IN_REGION").alias("type"))
    e = e.union(s.select(long("s_suppkey", SUPPLIER), long("s_nationkey", NATION), F.lit("IN_NATION")))
    e = e.union(c.select(long("c_custkey", CUSTOMER), long("c_nationkey", NATION), F.lit("IN_NATION")))
    return PropertyGraph(v, e.withColumn("id", F.xxhash64("src", "dst")))


def nations(spark: SparkSession, sf_dir: str, least: int = 0) -> PropertyGraph:
    """Nations and what their customers order from suppliers of another nation, weighted by the number of lines (more than least)."""
    line, o, c, s = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    e = line.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.filter("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    v = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.lit("Nation")).alias("labels"), F.col("n_name").alias("name"))
    return PropertyGraph(v, e.filter(F.col("weight") > least).withColumn("id", F.col("src") * 1000 + F.col("dst")).withColumn("type", F.lit("BUYS_FROM")))


def flow(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Event types and what follows what in each user's events; weight: how often."""
    from pyspark.sql import Window

    ev = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    after = ev.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("next is not null")
    kinds = ev.select("event_type").distinct()
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    v = kinds.select(number("event_type").alias("id"), F.array(F.lit("Event")).alias("labels"), F.col("event_type").alias("name"))
    e = after.groupBy("event_type", "next").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    e = e.select(number("event_type").alias("src"), number("next").alias("dst"), "weight")
    return PropertyGraph(v, e.withColumn("id", F.xxhash64("src", "dst")).withColumn("type", F.lit("THEN")))
