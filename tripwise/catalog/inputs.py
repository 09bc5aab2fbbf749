"""Trips, sales and reviews derived from the given tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.sources.reviews import reviews_for
from tripwise.sources.tables import load_table

# One text for both engines; ``{events}`` is the events table. The case
# distinctions put nulls, zeros and negative values among the trips.
TRIPS_SQL = """
SELECT event_id AS trip_id,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE ts END AS tpep_pickup_datetime,
  1 + event_id % 2 AS VendorID,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 7 AS DOUBLE) END AS passenger_count,
  CAST((event_id * 13) % 301 - 3 AS DOUBLE) / 10e0 AS trip_distance,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(1 + user_id % 6 AS DOUBLE) END AS RatecodeID,
  CASE WHEN event_id % 37 = 0 THEN NULL WHEN user_id % 9 = 0 THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
  1 + user_id % 4 AS payment_type,
  CASE WHEN event_id % 29 = 0 THEN -value ELSE value END AS fare_amount,
  CASE WHEN event_id % 53 = 0 THEN NULL
       ELSE value * CAST((event_id * 37) % 50 AS DOUBLE) / 100e0 END AS tip_amount,
  value * (1e0 + CAST((event_id * 37) % 50 AS DOUBLE) / 100e0) + 2.5e0 AS total_amount
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return spark.sql(TRIPS_SQL, events=events)


SALES_COLUMNS = ("sale_date", "region", "category", "sales", "profit")


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Line items with their order date, customer region and part type, or only ``columns`` of these.

    Only the tables that the columns come from are joined: every line item has its
    order and part and every order its customer, so the other joins change no row.
    No join hints: Catalyst broadcasts what the file sizes prove small, and
    adaptive execution splits skewed partitions of the shuffled rest.
    """
    amount = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    cost = F.lit(0.6) * F.col("l_quantity") * F.col("p_retailprice")
    wanted = columns or SALES_COLUMNS
    values = {
        "sale_date": F.to_date("o_orderdate"),
        "region": F.col("r_name"),
        "category": F.col("p_type"),
        "sales": amount.cast("decimal(18,4)"),
        "profit": (amount - cost).cast("decimal(18,4)"),
    }
    rows = table(spark, sf_dir, "lineitem")
    if not {"category", "profit"}.isdisjoint(wanted):
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if not {"sale_date", "region"}.isdisjoint(wanted):
        orders = table(spark, sf_dir, "orders")
        if "region" in wanted:
            orders = orders.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*[values[c].alias(c) for c in wanted])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive and a negative review per order."""
    return reviews_for(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, sentiment`` of the labelled documents; toxic ones are the negative ones."""
    labels = table(spark, sf_dir, "labels").filter("toxic IS NOT NULL")
    sentiment = F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("sentiment")
    known = table(spark, sf_dir, "documents").select("doc_id")
    return labels.select("doc_id", sentiment).join(known, "doc_id", "left_semi")


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, sentiment`` of the labelled documents."""
    return documents(spark, sf_dir).join(text_labels(spark, sf_dir), "doc_id")
