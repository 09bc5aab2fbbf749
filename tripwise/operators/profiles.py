"""Batch profiles: totals, time profiles, value counts and histograms.

All groupings here have few keys, so Spark's partial aggregation leaves at most
(partitions x keys) rows to shuffle however many rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripwise.functions.timeparts import is_weekend_day, pickup_hour, sunday_based_day
from tripwise.sources.tables import blank_nan

PICKUP = "tpep_pickup_datetime"
MEASURES = ("fare_amount", "tip_amount", "total_amount")
MONEY = "decimal(28,4)"


def above(column: str, bound: float, inclusive: bool = False) -> Column:
    """``column > bound`` that null and NaN fail; the plain comparison still reaches Parquet."""
    value = F.col(column)
    compared = value >= F.lit(bound) if inclusive else value > F.lit(bound)
    return compared & ~F.isnan(value.cast("double"))


def valid_trips(df: DataFrame, fare: str = "fare_amount") -> DataFrame:
    """Rows with a positive fare; NaN in the money columns becomes null."""
    kept = df.filter(above(fare, 0.0))
    return blank_nan(kept, [c for c in MEASURES if c in df.columns])


def preview(df: DataFrame, key: str, n: int = 5, columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in key order."""
    first = df.orderBy(key).limit(n)
    return first.select(*columns) if columns else first


def time_cube(df: DataFrame, ts: str = PICKUP) -> DataFrame:
    """Row count, and per money column value count and sum, for each hour and day of the week.

    At most 24 x 7 rows and one for trips without a time, whatever the size of the table; every
    profile of this module rolls them up. ``day_of_week`` is 1 = Sunday to 7 = Saturday. Money is
    added up as decimals, to a hundredth of a cent, so sums do not depend on their order; a value
    that no decimal holds (infinity) is missing. A measure that the table does not have is too.
    """
    present = [c for c in MEASURES if c in df.columns]
    money = {c: F.col(c).try_cast(MONEY) if c in present else F.lit(None).cast(MONEY) for c in MEASURES}
    rows = df.select(
        pickup_hour(ts).alias("pickup_hour"),
        sunday_based_day(ts).alias("day_of_week"),
        *[value.alias(c) for c, value in money.items()],
    )
    counts = [F.count(c).alias(f"{c}_count") for c in MEASURES]
    sums = [F.sum(c).alias(f"{c}_sum") for c in MEASURES]
    return rows.groupBy("pickup_hour", "day_of_week").agg(F.count("*").alias("n_rows"), *counts, *sums)


def _total(measure: str) -> Column:
    return F.sum(f"{measure}_sum").cast("double")


def _mean(measure: str) -> Column:
    return F.try_divide(_total(measure), F.sum(f"{measure}_count").cast("double"))


def _count(measure: str) -> Column:
    return F.coalesce(F.sum(f"{measure}_count"), F.lit(0)).cast("bigint")


def revenue_summary(cube: DataFrame) -> DataFrame:
    """Ride count, sums and means of the three money columns."""
    return cube.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("total_rides"),
        _total("fare_amount").alias("total_fare_amount"),
        _total("tip_amount").alias("total_tip_amount"),
        _total("total_amount").alias("total_amount"),
        _mean("fare_amount").alias("average_fare"),
        _mean("tip_amount").alias("average_tip"),
        _mean("total_amount").alias("average_total"),
    )


def hourly_profile(cube: DataFrame, fare: str = "fare_amount") -> DataFrame:
    """Mean fare, trip count and fare total per pickup hour, in hour order; trips without a time are left out."""
    return (
        cube.filter(F.col("pickup_hour").isNotNull())
        .groupBy("pickup_hour")
        .agg(_mean(fare).alias("avg_fare"), _count(fare).alias("trip_count"), _total(fare).alias("total_fare"))
        .orderBy("pickup_hour")
    )


def top_hour(hourly: DataFrame, measure: str) -> DataFrame:
    """The hour with the largest measure; the earlier hour wins a tie."""
    return hourly.orderBy(F.col(measure).desc(), F.col("pickup_hour").asc()).limit(1)


def busiest_hour(hourly: DataFrame) -> DataFrame:
    return top_hour(hourly, "trip_count")


def highest_avg_fare_hour(hourly: DataFrame) -> DataFrame:
    return top_hour(hourly, "avg_fare")


def weekend_profile(cube: DataFrame, fare: str = "fare_amount", days: str = "sat_sun") -> DataFrame:
    """Trip count and mean fare, weekdays against the weekend."""
    part = F.when(is_weekend_day("day_of_week", days), "weekend").otherwise("weekday")
    return (
        cube.filter(F.col("day_of_week").isNotNull())
        .groupBy(part.alias("day_type"))
        .agg(_count(fare).alias("trip_count"), _mean(fare).alias("avg_fare"))
        .withColumn("is_weekend", (F.col("day_type") == "weekend").cast("int"))
        .select("is_weekend", "day_type", "trip_count", "avg_fare")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, in value order; null values are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(column)
    )


def histogram(df: DataFrame, value: Column | str, bins: int = 30) -> DataFrame:
    """Equal-width bins from the minimum to the maximum, the last one closed on the right.

    Bounds come from a scalar subquery. As in numpy, a value that rounding put on
    the wrong side of a bin edge is moved to its bin, a constant column is
    widened by a half on both sides, and empty bins are listed.
    """
    data = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("x"))
    data = data.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    widen = F.when(F.min("x") == F.max("x"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = data.agg(
        F.struct((F.min("x") - widen).alias("lo"), (F.max("x") + widen).alias("hi")).alias("span")
    ).scalar()
    bounds = [span.getField("lo").alias("lo"), span.getField("hi").alias("hi")]
    lo, hi = F.col("lo"), F.col("hi")

    def edge(i: Column) -> Column:
        return F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / F.lit(float(bins))))

    last = F.lit(bins - 1).cast("bigint")
    guess = F.least(F.floor((F.col("x") - lo) / (hi - lo) * F.lit(float(bins))), last)
    too_high = F.col("x") < edge(F.col("guess"))
    too_low = (F.col("guess") < last) & (F.col("x") >= edge(F.col("guess") + 1))
    placed = (
        data.select("x", *bounds)
        .withColumn("guess", guess)
        .select(
            (F.col("guess") - too_high.cast("int") + too_low.cast("int")).alias("bin"),
            F.lit(1).cast("bigint").alias("one"),
        )
    )
    empty = df.sparkSession.range(0, bins, 1, numPartitions=1).select(
        F.col("id").alias("bin"), F.lit(0).cast("bigint").alias("one")
    )
    return (
        placed.unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("one").alias("n"))
        .select("bin", "n", *bounds)
        .select(
            "bin",
            edge(F.col("bin")).alias("lower"),
            edge(F.col("bin") + 1).alias("upper"),
            "n",
        )
        .orderBy("bin")
    )
