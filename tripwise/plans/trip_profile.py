"""Batch profile of a trip table: load, validate, profile, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tripwise.operators import profiles
from tripwise.sources.shared import written
from tripwise.sources.sinks import write_table
from tripwise.sources.tables import load_table, require_columns

PROFILE_COLUMNS = [profiles.PICKUP, *profiles.MEASURES]


@dataclass
class TripProfile:
    """``cube`` is a written table of at most 169 rows; the others roll it up and read no trip."""

    cube: DataFrame
    summary: DataFrame
    hourly: DataFrame
    busiest_hour: DataFrame
    highest_avg_fare_hour: DataFrame
    weekend: DataFrame


def profile_trips(trips: DataFrame, weekend_days: str = "sat_sun") -> TripProfile:
    """All profiles of the valid trips from one scan of them."""
    require_columns(trips, [profiles.PICKUP, "fare_amount"])
    used = trips.select(*[c for c in PROFILE_COLUMNS if c in trips.columns])
    cube = written(profiles.time_cube(profiles.valid_trips(used)), "time_cube")
    hourly = profiles.hourly_profile(cube)
    return TripProfile(
        cube=cube,
        summary=profiles.revenue_summary(cube),
        hourly=hourly,
        busiest_hour=profiles.busiest_hour(hourly),
        highest_avg_fare_hour=profiles.highest_avg_fare_hour(hourly),
        weekend=profiles.weekend_profile(cube, days=weekend_days),
    )


def run_profile(
    spark: SparkSession,
    input_path: str,
    output_path: str | None = None,
    force_csv: bool = False,
    schema: StructType | None = None,
    weekend_days: str = "sat_sun",
) -> TripProfile:
    """Profile the table at ``input_path`` and save the hourly profile if asked to."""
    result = profile_trips(load_table(spark, input_path, schema), weekend_days)
    if output_path:
        write_table(result.hourly, output_path, force_csv=force_csv, single_file=True)
    return result
