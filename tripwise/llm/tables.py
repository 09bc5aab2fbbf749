"""Reading the given tables, column clashes and partition counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that one task of a keyed exchange should get.
TASK_BYTES = 8 << 20
# Bytes of rows that a worker is handed at once, and the setting for it.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
SWEEP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(n_bytes: int, least: int = 12, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for so many bytes; grows with the data, without an upper bound."""
    return max(least, -(-int(n_bytes) // task_bytes))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> AbstractContextManager[None]:
    """Jobs run inside hand their rows to ``mapInArrow`` in batches of about so many bytes.

    By rows alone a batch has 10,000 of them, however long, and stands in the JVM and the worker at once.
    """
    return _setting(spark, BATCH_SETTING, str(n_bytes))


def swept_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of a query that ends inside go with it.

    By default they stay until the driver collects its garbage, and those of many steps stand on disk at once.
    """
    return _setting(spark, SWEEP_SETTING, "true")
