"""Written intermediate tables in the folder that the cluster shares: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="grafloom-")
    return _OWN[app]


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written once and read back: the reader prunes columns and knows the size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a task sorts or aggregates at once is to be about so many rows, however many there are.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many rows, dealt out by keys: to more tasks than the session's shuffles have where those would get too many."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // ROWS_A_TASK)), *keys)


def dealt_by_range(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """As dealt(), by ranges of the first key, so that near ones come together; each part is sorted by all keys."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(max(n, -(-rows // ROWS_A_TASK)), keys[0]).sortWithinPartitions(*keys)


def co_located(df: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """df (of so many rows, if many) dealt out by key once and kept so, for loops that join it on key round after round; unpersist() it after.

    A lost executor's part is dealt out again from df, which should be a written table.
    """
    from pyspark import StorageLevel

    return dealt(df, rows, key).persist(StorageLevel.MEMORY_AND_DISK)
