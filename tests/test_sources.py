import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.plans import plan_of
from tripwise.operators import profiles
from tripwise.plans.tip_report import report_tips
from tripwise.plans.trip_profile import profile_trips, run_profile
from tripwise.sources.shared import discard, fresh_path, shared_folder, written
from tripwise.sources.sinks import write_table
from tripwise.sources.tables import (
    TRIP_COLUMNS,
    TRIP_SCHEMA,
    blank_nan,
    load_table,
    parse_timestamps,
    require_columns,
)

TS = dt.datetime(2023, 1, 6, 18, 30, 0, 123456)


@pytest.fixture(scope="module")
def trips(spark):
    rows = [
        (TS, 1, 1.0, 2.5, 1.0, "N", 1, 10.0, 2.5, 13.0),
        (TS + dt.timedelta(hours=1), 2, None, 0.0, None, None, 2, 20.25, None, 21.0),
        (None, 2, 2.0, 1.0, 1.0, "Y", 1, -3.0, 0.0, -3.0),
    ]
    return spark.createDataFrame(rows, TRIP_SCHEMA)


@pytest.mark.parametrize("name", ["t.parquet", "t.csv", "t.csv.gz"])
def test_roundtrip_by_suffix(spark, trips, name):
    path = write_table(trips, fresh_path(spark, name))
    back = load_table(spark, path, TRIP_SCHEMA)
    assert back.schema == trips.schema
    assert sorted(map(repr, back.collect())) == sorted(map(repr, trips.collect()))


def test_csv_without_schema_infers_numbers_and_parses_the_timestamp(spark, trips):
    back = load_table(spark, write_table(trips, fresh_path(spark, "t.csv")))
    types = dict(back.dtypes)
    assert types["tpep_pickup_datetime"] == "timestamp_ntz"
    assert types["fare_amount"] == "double"
    assert back.filter(F.col("tpep_pickup_datetime") == F.lit(TS)).count() == 1


def test_force_csv_and_single_file(spark, trips):
    path = write_table(trips.repartition(3), fresh_path(spark, "out"), force_csv=True, single_file=True)
    text = spark.read.text(path)
    assert text.filter(F.col("value").startswith("tpep_pickup_datetime,")).count() == 1
    assert len(text.inputFiles()) == 1


def test_unknown_suffix_and_missing_path_are_value_errors(spark):
    with pytest.raises(ValueError):
        load_table(spark, "/root/testdata/table.orc")
    with pytest.raises(ValueError):
        load_table(spark, "/nowhere/table.parquet")
    with pytest.raises(ValueError):
        load_table(spark, "/nowhere/table.csv", TRIP_SCHEMA)


def test_missing_columns_are_a_key_error(trips):
    assert require_columns(trips, ["fare_amount"]) is trips
    with pytest.raises(KeyError):
        require_columns(trips, ["fare_amount", "nope"])
    with pytest.raises(KeyError):
        profile_trips(trips.drop("fare_amount"))


def test_unreadable_timestamps_become_null(spark):
    df = spark.createDataFrame([("2023-01-06 18:30:00",), ("soon",), (None,)], "tpep_pickup_datetime string")
    values = [r[0] for r in parse_timestamps(df).collect()]
    assert values == [dt.datetime(2023, 1, 6, 18, 30), None, None]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, n int")
    assert blank_nan(df, ["x", "n"]).agg(F.sum("x"), F.sum("n")).first() == (2.0, 3)


def test_written_table_is_under_the_named_folder(spark):
    table = written(spark.range(5).toDF("n"), "numbers")
    assert table.count() == 5
    assert all(shared_folder(spark).removeprefix("file:") in f for f in table.inputFiles())
    discard(table)
    assert not Path(table.written_to.removeprefix("file:")).exists()


def test_profile_reads_four_columns_and_pushes_the_fare_filter(spark, trips):
    path = write_table(trips, fresh_path(spark, "t.parquet"))
    plan = plan_of(profiles.time_cube(profiles.valid_trips(load_table(spark, path))), "formatted")
    assert "GreaterThan(fare_amount,0.0)" in plan
    read = "tpep_pickup_datetime:timestamp_ntz,fare_amount:double,tip_amount:double,total_amount:double"
    assert f"ReadSchema: struct<{read}>" in plan
    projected = load_table(spark, path).select(*TRIP_COLUMNS[:2])
    assert "ReadSchema: struct<tpep_pickup_datetime:timestamp_ntz,VendorID:bigint>" in plan_of(
        projected, "formatted"
    )


def test_run_profile_saves_the_hourly_table(spark, trips):
    source = write_table(trips, fresh_path(spark, "t.parquet"))
    target = fresh_path(spark, "hourly.csv")
    result = run_profile(spark, source, target)
    saved = load_table(spark, target, result.hourly.schema)
    assert saved.collect() == result.hourly.collect()


def test_tip_report_of_a_sample_is_exported(spark, trips):
    keyed = trips.withColumn("trip_id", F.monotonically_increasing_id())
    target = fresh_path(spark, "processed.csv")
    report = report_tips(keyed, "trip_id", sample_size=2, bins=3, export_path=target)
    saved = load_table(spark, target, report.processed.schema)
    assert sorted(map(repr, saved.collect())) == sorted(map(repr, report.processed.collect()))
    assert sum(r["n"] for r in report.tip_rates.collect()) == report.processed.count()


def test_a_large_result_is_not_one_file(spark):
    path = fresh_path(spark, "large.parquet")
    with pytest.raises(ValueError, match="single file"):
        write_table(spark.range(100_001), path, single_file=True)
    assert not Path(path.removeprefix("file:")).exists()
    write_table(spark.range(100_000), path, single_file=True)
    assert len(list(Path(path.removeprefix("file:")).glob("part-*"))) == 1
