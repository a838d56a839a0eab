"""Incrementally kept results: counters by change streams, and betweenness that is updated by what changed."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.centrality import betweenness
from ..operators.meta import stats_of, stats_rows
from ..plans.lineage import written
from ..plans.loops import components
from ..registry import register

#: A change: (sign: 1 or -1, kind as of stats_rows, key).
CHANGES = "sign int, kind string, key string"


def changes_of(events: DataFrame) -> DataFrame:
    """Counter changes of events (event: created_vertex, deleted_vertex, created_edge, deleted_edge, set_label, removed_label, set_property,
    removed_property; labels, type, keys, src_labels, dst_labels); batch or streaming."""
    sign = F.when(F.col("event").startswith("created") | F.col("event").startswith("set"), 1).otherwise(-1)
    s = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    many = lambda kind, array: F.transform(F.coalesce(array, F.expr("cast(array() as array<string>)")), lambda x: s(kind, x))
    tail = F.concat(F.lit("]->()"))
    pattern = F.concat(
        F.array(s("pattern", F.concat(F.lit("()-[:"), "type", tail))),
        F.transform("src_labels", lambda x: s("pattern", F.concat(F.lit("(:"), x, F.lit(")-[:"), F.col("type"), tail))),
        F.transform("dst_labels", lambda x: s("pattern", F.concat(F.lit("()-[:"), F.col("type"), F.lit("]->(:"), x, F.lit(")")))),
    )
    vertex = F.concat(F.array(s("node", F.lit("nodes"))), many("label", F.col("labels")), many("property", F.col("keys")))
    edge = F.concat(F.array(s("relationship", F.lit("relationships")), s("type", F.col("type"))), many("property", F.col("keys")), pattern)
    parts = F.when(F.col("event").endswith("vertex"), vertex).when(F.col("event").endswith("edge"), edge).when(F.col("event").endswith("label"), many("label", F.col("labels"))).otherwise(many("property", F.col("keys")))
    return events.select(sign.alias("sign"), F.explode(parts).alias("c")).select("sign", "c.kind", "c.key")


def counters(changes: DataFrame) -> DataFrame:
    """(kind, key, n): streaming in complete or update mode, its state a number for each key."""
    return changes.groupBy("kind", "key").agg(F.sum("sign").alias("n"))


class OnlineStats:
    """meta.*: counters kept in a table that each micro-batch adds to; a batch that is run again isn't counted twice."""

    def __init__(self, g: PropertyGraph | None = None, spark: SparkSession | None = None) -> None:
        self.spark = g.spark if g else spark
        self.table = written(stats_rows(g), "counters") if g else self.spark.createDataFrame([], "kind string, key string, n long")
        self.last = -1

    def update(self, events: DataFrame, batch: int | None = None) -> None:
        if batch is not None and batch <= self.last:
            return
        delta = counters(changes_of(events))
        self.table = written(self.table.union(delta).groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("n <> 0"), "counters")
        self.last = self.last if batch is None else batch

    def follow(self, events: DataFrame, checkpoint: str):
        """Start a query that applies a stream of events."""
        return events.writeStream.foreachBatch(lambda df, i: self.update(df, i)).option("checkpointLocation", checkpoint).outputMode("append").start()

    def stats(self) -> DataFrame:
        return stats_of(self.table)


#: Counters go with the graph object that they follow.
_STATS: WeakKeyDictionary[PropertyGraph, OnlineStats] = WeakKeyDictionary()


def _stats(g: PropertyGraph) -> OnlineStats:
    if g not in _STATS:
        _STATS[g] = OnlineStats(g)
    return _STATS[g]


@register("meta.stats_online")
def stats_online(g: PropertyGraph, update_stats: bool = False) -> DataFrame:
    if update_stats:
        _STATS.pop(g, None)
    return _stats(g).stats()


@register("meta.update")
def update(g: PropertyGraph, events: DataFrame) -> None:
    _stats(g).update(events)


@register("meta.reset")
def reset(g: PropertyGraph) -> None:
    _STATS.pop(g, None)


class OnlineBetweenness:
    """Scores of the last graph seen; a change recomputes the weakly connected components that it touches, and no others."""

    def __init__(self) -> None:
        self.graph: PropertyGraph | None = None
        self.scores: DataFrame | None = None
        self.normalize = True

    def _sums(self, g: PropertyGraph) -> DataFrame:
        return betweenness(g, directed=False, normalized=False)

    def set(self, g: PropertyGraph, normalize: bool = True) -> DataFrame:
        self.graph, self.normalize = g, normalize
        self.scores = written(self._sums(g), "betweenness")
        return self._result(normalize)

    def _result(self, normalize: bool) -> DataFrame:
        n = self.graph.V.count()
        scale = 2.0 / ((n - 1) * (n - 2)) if normalize and n > 2 else 1.0
        return self.scores.select("node", (F.col("betweenness_centrality") * scale).alias("betweenness_centrality"))

    def get(self, g: PropertyGraph, normalize: bool = True) -> DataFrame:
        """The kept scores; a graph that has changed since raises."""
        if self.graph is None:
            return self.set(g, normalize)
        same = lambda a, b: a.join(b, a.columns, "left_anti").isEmpty() and b.join(a, a.columns, "left_anti").isEmpty()
        if not same(g.V.select("id"), self.graph.V.select("id")) or not same(g.E.select("src", "dst"), self.graph.E.select("src", "dst")):
            raise ValueError("the graph has changed since scores were set; call update or set")
        return self._result(normalize)

    def update(self, g: PropertyGraph, normalize: bool = True) -> DataFrame:
        """g: the graph after the change."""
        if self.graph is None:
            return self.set(g, normalize)
        old, new = self.graph.E.select("src", "dst"), g.E.select("src", "dst")
        changed = old.exceptAll(new).union(new.exceptAll(old))
        ends = changed.select(F.col("src").alias("id")).union(changed.select("dst")).distinct()
        parts = components(g.V, g.E)
        touched = written(parts.join(parts.join(ends, "id", "left_semi").select("component").distinct(), "component", "left_semi").select("id"), "touched")
        fresh = self._sums(g.subgraph(touched))
        kept = self.scores.join(touched.withColumnRenamed("id", "node"), "node", "left_anti").join(g.V.select(F.col("id").alias("node")), "node", "left_semi")
        both = kept.union(fresh)
        lone = g.V.select(F.col("id").alias("node")).join(both, "node", "left_anti").withColumn("betweenness_centrality", F.lit(0.0))
        self.scores, self.graph = written(both.union(lone), "betweenness"), g
        return self._result(normalize)


_ONLINE = OnlineBetweenness()


@register("betweenness_centrality_online.set")
def bc_set(g: PropertyGraph, normalize: bool = True, threads: int | None = None) -> DataFrame:
    return _ONLINE.set(g, normalize)


@register("betweenness_centrality_online.get")
def bc_get(g: PropertyGraph, normalize: bool = True) -> DataFrame:
    return _ONLINE.get(g, normalize)


@register("betweenness_centrality_online.update")
def bc_update(g: PropertyGraph, normalize: bool = True, threads: int | None = None) -> DataFrame:
    return _ONLINE.update(g, normalize)


@register("betweenness_centrality_online.reset")
def bc_reset(g: PropertyGraph) -> DataFrame:
    _ONLINE.__init__()
    return g.spark.createDataFrame([("the scores are cleared",)], "message string")
