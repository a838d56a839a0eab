"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


#: So many edges, 16 bytes each, are a small part of what any task holds.
FEW = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(up, up)
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = sorted((root(a), root(b)))
                parent[b] = a
        nodes = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(id, component: the least id it is connected to) for every node of edges (a, b).

    Up to few edges are joined up in one task; more of them by rounds of stars.
    A large star links each node's larger neighbours to its least one, a small
    star its smaller ones (Kiveris et al. 2014); the edges become stars in
    logarithmically many rounds.  Each round is a partial aggregate and a join
    whose hot nodes Spark may split, and is written to the shared folder.
    """
    spark = edges.sparkSession
    edges = written(spark, edges.select("a", "b").filter("a <> b"), "given")
    if edges.count() <= few:
        return _in_one_task(edges)
    now = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(spark, both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(spark, large.distinct(), "large")
        low = written(spark, large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = written(spark, small.filter("u <> v").distinct(), "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
