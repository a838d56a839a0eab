"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import shared_dir

_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are removed at the end, but for lasting ones: nothing may read them later."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in paths:
            remove(spark, path)


def new_path(spark: SparkSession, label: str, lasting: bool = False) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not lasting and (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def written(spark: SparkSession, df: DataFrame, label: str, codec: str = "zstd", lasting: bool = False) -> DataFrame:
    """Write df once and return it as read back: lineage is cut and a lost executor loses nothing.

    The reader prunes columns and knows the size, which checkpoint() doesn't.
    """
    path = new_path(spark, label, lasting)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches have fewer rows than the usual 10,000, as a row is a whole text; a session's own setting stays.

    A batch is held by the JVM outside its heap, while it is copied, and by Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)
