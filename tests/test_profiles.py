import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.plans import plan_of
from tripwise.operators import profiles
from tripwise.plans.trip_profile import profile_trips, run_profile

NAN = float("nan")
SCHEMA = "tpep_pickup_datetime timestamp_ntz, fare_amount double, tip_amount double, total_amount double"


def at(day, hour):
    """January 2023: the 6th is a Friday."""
    return dt.datetime(2023, 1, day, hour)


@pytest.fixture(scope="module")
def trips(spark):
    rows = [
        (at(6, 18), 10.0, 1.0, 11.0),  # Friday
        (at(7, 18), 20.0, None, 20.0),  # Saturday
        (at(8, 5), 60.0, NAN, 66.0),  # Sunday
        (at(9, 5), 40.0, 4.0, 44.0),  # Monday
        (None, 5.0, 1.0, 6.0),
        (at(9, 7), 0.0, 1.0, 1.0),
        (at(9, 7), -5.0, 1.0, 1.0),
        (at(9, 7), None, 1.0, 1.0),
        (at(9, 7), NAN, 1.0, 1.0),
    ]
    return profiles.time_cube(profiles.valid_trips(spark.createDataFrame(rows, SCHEMA)))


def test_only_positive_fares_count_and_nan_is_skipped(trips):
    row = profiles.revenue_summary(trips).first()
    assert row["total_rides"] == 5
    assert row["total_fare_amount"] == 135.0
    assert row["total_tip_amount"] == 6.0
    assert row["average_tip"] == 2.0
    assert row["average_total"] == pytest.approx(147.0 / 5)


def test_hourly_profile_leaves_out_rows_without_a_time(trips):
    assert [tuple(r) for r in profiles.hourly_profile(trips).collect()] == [
        (5, 50.0, 2, 100.0),
        (18, 15.0, 2, 30.0),
    ]


def test_earlier_hour_wins_a_tie(trips):
    hourly = profiles.hourly_profile(trips)
    assert profiles.busiest_hour(hourly).first()["pickup_hour"] == 5
    assert profiles.highest_avg_fare_hour(hourly).first()["pickup_hour"] == 5


def test_both_weekend_definitions(trips):
    def by_part(days):
        rows = profiles.weekend_profile(trips, days=days).collect()
        return {r["day_type"]: (r["is_weekend"], r["trip_count"], r["avg_fare"]) for r in rows}

    assert by_part("sat_sun") == {"weekday": (0, 2, 25.0), "weekend": (1, 2, 40.0)}
    assert by_part("fri_sat") == {"weekday": (0, 2, 50.0), "weekend": (1, 2, 15.0)}
    with pytest.raises(ValueError):
        profiles.weekend_profile(trips, days="mon")


def test_profile_scans_the_trips_once(spark, tmp_path):
    """The cube is one scan; nothing that the profile returns reads the trips."""
    path = str(tmp_path / "trips.parquet")
    spark.createDataFrame([(at(6 + i % 4, i % 24), i / 3, None, 1.0) for i in range(1, 500)], SCHEMA).write.parquet(path)
    profile = run_profile(spark, path)
    cube = profiles.time_cube(profiles.valid_trips(spark.read.parquet(path)))
    assert plan_of(cube).count("FileScan") == 1 and plan_of(cube).count("Exchange") == 1
    for result in (profile.cube, profile.summary, profile.hourly, profile.busiest_hour, profile.weekend):
        assert not [file for file in result.inputFiles() if path in file]
    assert profile.cube.count() <= 169


def test_sums_are_exact_and_do_not_depend_on_the_layout(spark):
    """0.1 ten thousand times beside a large value, in three layouts."""
    rows = [(at(6, 1), 0.1, 0.1, 1e12)] * 10_000
    df = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(profiles.revenue_summary(profiles.time_cube(df.repartition(n))).first()) for n in (1, 3, 8)}
    assert found == {(10_000, 1000.0, 1000.0, 1e16, 0.1, 0.1, 1e12)}


def test_profile_of_two_columns_infinite_fares_and_no_rows(spark):
    rows = [(at(6, 18), 10.0), (at(6, 18), float("inf"))]
    df = spark.createDataFrame(rows, "tpep_pickup_datetime timestamp_ntz, fare_amount double")
    profile = profile_trips(df)
    assert tuple(profile.summary.first()) == (2, 10.0, None, None, 10.0, None, None)
    assert [tuple(r) for r in profile.hourly.collect()] == [(18, 10.0, 1, 10.0)]
    empty = profile_trips(df.limit(0))
    assert empty.summary.first()["total_rides"] == 0 and empty.hourly.count() == 0


def test_value_counts_are_sorted_and_skip_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in profiles.value_counts(df, "c").collect()] == [("a", 1), ("b", 2)]


def test_preview_is_in_key_order(spark):
    df = spark.range(100).repartition(7)
    assert [r[0] for r in profiles.preview(df, "id", 3).collect()] == [0, 1, 2]


def test_top_hour_is_a_top_k_not_a_sort(trips):
    assert "TakeOrderedAndProject" in plan_of(profiles.busiest_hour(profiles.hourly_profile(trips)))


def histogram_of(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = profiles.histogram(df, "x", bins).collect()
    return [r["n"] for r in rows], [r["lower"] for r in rows] + [rows[-1]["upper"]]


def test_constant_column_is_widened(spark):
    counts, edges = histogram_of(spark, [3.0, 3.0], 4)
    expected, expected_edges = np.histogram([3.0, 3.0], bins=4)
    assert counts == expected.tolist() and edges == expected_edges.tolist()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.integers(-1000, 1000).map(lambda n: n / 100), min_size=1, max_size=60),
    st.integers(1, 30),
)
def test_histogram_equals_numpy(spark, values, bins):
    counts, edges = histogram_of(spark, values, bins)
    expected, expected_edges = np.histogram(values, bins=bins)
    assert counts == expected.tolist()
    assert edges == pytest.approx(expected_edges.tolist())
