"""Shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SWEEP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a ``local`` master may go without the setting; it then gets one
    temporary folder per application.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_SETTING} to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="tripwise-")
    return _local_folders[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has written to yet."""
    return f"{shared_folder(spark)}/tripwise/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table survives lost executors, cuts the lineage and gives Catalyst real
    sizes to choose the join strategy from.
    """
    path = fresh_path(df.sparkSession, f"{name}.parquet")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


@contextmanager
def swept_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that ends inside go with it, not when the driver collects its garbage."""
    before = spark.conf.get(SWEEP_SETTING, None)
    spark.conf.set(SWEEP_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP_SETTING)
        else:
            spark.conf.set(SWEEP_SETTING, before)


def written_in_rounds(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """``written`` for a table made part by part: a part's shuffle files go before the next part is made.

    So the disk holds the table and the shuffles of one part at a time. Parts must have the same columns.
    """
    path, schema, spark = None, None, None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or fresh_path(spark, f"{name}.parquet")
        with swept_shuffles(spark):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.written_to = path
    return table


def bytes_of(table: DataFrame) -> int:
    """The size of the files of a ``written`` table."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` wrote, once nothing reads it any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
