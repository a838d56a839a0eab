"""Small files in whatever store Spark reads, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    """text as a file; with append after what the file holds, which is written anew, as few stores append."""
    store, where = _opened(spark, path)
    if append and store.exists(where):
        text = read_text(spark, path) + text
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder; one that isn't there raises."""
    store, where = _opened(spark, path)
    if not store.delete(where, True):
        raise FileNotFoundError(path)
