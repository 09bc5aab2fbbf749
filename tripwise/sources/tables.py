"""Loading tables and guarding their shape."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# The columns of a trip table and their types.
TRIP_SCHEMA = StructType(
    [
        StructField("tpep_pickup_datetime", TimestampNTZType()),
        StructField("VendorID", LongType()),
        StructField("passenger_count", DoubleType()),
        StructField("trip_distance", DoubleType()),
        StructField("RatecodeID", DoubleType()),
        StructField("store_and_fwd_flag", StringType()),
        StructField("payment_type", LongType()),
        StructField("fare_amount", DoubleType()),
        StructField("tip_amount", DoubleType()),
        StructField("total_amount", DoubleType()),
    ]
)

TRIP_COLUMNS = TRIP_SCHEMA.names

TIMESTAMP_COLUMNS = ("tpep_pickup_datetime",)


def load_table(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    timestamps: Iterable[str] = TIMESTAMP_COLUMNS,
) -> DataFrame:
    """Load ``.parquet``, ``.csv`` or ``.csv.gz`` by suffix; anything else is a ``ValueError``.

    ``path`` is any Hadoop file system URI, a single file or a directory. CSV
    without a ``schema`` costs an extra inference pass over the text, so pass
    one for large inputs. A gzip file is read by one task; ship many files, or
    ``repartition`` the result when the work after the scan is heavy.
    """
    suffix = path.lower().rstrip("/")
    try:
        if suffix.endswith(".parquet"):
            reader = spark.read if schema is None else spark.read.schema(schema)
            return reader.parquet(path)
        if suffix.endswith((".csv", ".csv.gz")):
            reader = spark.read.option("header", True)
            if schema is not None:
                return reader.schema(schema).csv(path)
            return parse_timestamps(reader.option("inferSchema", True).csv(path), timestamps)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"No such input: {path}") from error
    raise ValueError(f"Unsupported input format, expected .parquet, .csv or .csv.gz: {path}")


def parse_timestamps(df: DataFrame, columns: Iterable[str] = TIMESTAMP_COLUMNS) -> DataFrame:
    """Coerce the given columns to zone-less timestamps; unreadable text becomes null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).try_cast("timestamp_ntz") for c in present})


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise ``KeyError`` before any job starts when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"Input is missing the columns {missing}")
    return df


def blank_nan(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NaN to null, so that aggregates skip it and comparisons with it fail.

    Filter on the raw column first (see ``operators.profiles.valid_trips``):
    a predicate on the wrapped column no longer reaches the Parquet reader.
    """
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in columns if c in floating}
    )
