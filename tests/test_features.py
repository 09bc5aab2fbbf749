import datetime as dt
import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.plans import plan_of
from tripwise.operators import features, ranks
from tripwise.operators.ranks import values_at_ranks
from tripwise.sources.shared import fresh_path
from tripwise.sources.tables import TRIP_SCHEMA

NAN = float("nan")
FRIDAY = dt.datetime(2023, 1, 6, 18, 30)


def trip(ts=FRIDAY, passengers=1.0, distance=2.0, fare=10.0, tip=2.5):
    return (ts, 1, passengers, distance, 1.0, "N", 1, fare, tip, 13.0)


def built(spark, *rows, **options):
    return features.trip_features(spark.createDataFrame(list(rows), TRIP_SCHEMA), **options)


def test_label_includes_the_threshold_and_a_missing_tip_is_low(spark):
    rows = built(spark, trip(), trip(tip=2.49), trip(tip=None), trip(tip=NAN)).collect()
    assert [(r["tip_rate"], r["high_tip"]) for r in rows] == [(0.25, 1), (2.49 / 10.0, 0), (None, 0), (None, 0)]
    assert rows[0]["pickup_hour"] == 18 and rows[0]["pickup_dayofweek"] == 4
    assert built(spark, trip(), trip(tip=None), drop_null_tip=True).count() == 1


@pytest.mark.parametrize(
    "bad",
    [
        {"ts": None},
        {"fare": 0.0},
        {"fare": NAN},
        {"fare": None},
        {"distance": -0.1},
        {"distance": NAN},
        {"passengers": 0.0},
        {"passengers": None},
        {"passengers": NAN},
    ],
)
def test_invalid_trips_are_dropped(spark, bad):
    assert built(spark, trip(**bad), trip(distance=0.0)).count() == 1


def test_text_timestamps_are_coerced(spark):
    df = spark.createDataFrame([trip()], TRIP_SCHEMA).withColumn(
        "tpep_pickup_datetime", F.explode(F.array(F.lit("2023-01-06 18:30:00"), F.lit("n/a")))
    )
    assert [r["pickup_hour"] for r in features.trip_features(df).collect()] == [18]


def test_features_are_one_narrow_stage(spark):
    plan = plan_of(built(spark, trip()))
    assert "Exchange" not in plan and "Python" not in plan


def test_model_input_needs_all_features(spark):
    df = built(spark, trip(), trip()).withColumn("RatecodeID", F.lit(None).cast("double"))
    assert features.model_input(df).count() == 0
    kept = features.model_input(built(spark, trip()), exclude_leaky=True).columns
    assert not set(features.LEAKY_FEATURES) & set(kept)


def test_median_of_even_odd_empty_and_spread_values(spark):
    rows = [
        (1.0, 1.0, None, 1e308, 5),
        (2.0, NAN, None, -1e308, 5),
        (3.0, 7.0, NAN, 0.0, 5),
        (4.0, 2.0, None, 1e-300, 5),
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int")
    assert features.exact_medians(df, list("abcde")) == {"a": 2.5, "b": 2.0, "d": 5e-301, "e": 5.0}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=80), st.sampled_from([2, 16, 4096]))
def test_median_equals_a_full_sort(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = features.exact_medians(df, ["x"], bins)["x"]
    assert found == pytest.approx(statistics.median(values), rel=1e-15, abs=1e-300)


def test_ranks_of_infinite_and_tiny_values(spark):
    values = [float("-inf"), -1.0, 0.0, 5e-324, 1e-323, 1.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = values_at_ranks(df, {"x": lambda n: range(n)}, bins=2)
    assert found == {"x": dict(enumerate(values))}
    with pytest.raises(ValueError):
        values_at_ranks(df, {"x": lambda n: [n]})


def test_median_takes_at_most_three_scans(spark, monkeypatch):
    scans = []
    monkeypatch.setattr(ranks, "_scanned", lambda df: scans.append(1) or df.collect())
    df = spark.range(300_000).select((F.xxhash64("id") / F.lit(2.0**40)).alias("x"), (F.col("id") % 7).alias("y"))
    found = features.exact_medians(df, ["x", "y"])
    assert len(scans) <= 3
    assert found == {c: df.agg(F.median(c)).first()[0] for c in "xy"}


def test_median_with_a_third_of_all_rows_on_one_value(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 7.25).otherwise(F.col("id") / 100.0).alias("x")
    )
    expected = float(np.median([7.25 if i % 3 == 0 else i / 100.0 for i in range(30000)]))
    assert features.exact_medians(df, ["x"])["x"] == expected


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (6.0, 3.0)], "a double, b double")
    model = features.PopulationScaler(inputCols=["a", "b"], outputCols=["x", "y"]).fit(df)
    rows = model.transform(df).collect()
    a = np.array([1.0, 2.0, 6.0])
    assert [r["x"] for r in rows] == pytest.approx(((a - a.mean()) / a.std()).tolist())
    assert [r["y"] for r in rows] == [0.0, 0.0, 0.0]


def test_imputer_fills_with_training_values_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    model = features.MedianImputer(inputCols=["x"], outputCols=["x"]).fit(train)
    test = spark.createDataFrame([(None,), (NAN,), (9.0,)], "x double")
    assert [r["x"] for r in model.transform(test).collect()] == [2.0, 2.0, 9.0]
    assert model.fitted() == {"x": 2.0}
    with pytest.raises(ValueError):
        features.MedianImputer(inputCols=["x"], outputCols=["x"]).fit(train.filter("x IS NULL"))


def test_unknown_and_missing_categories(spark):
    train = spark.createDataFrame([("b", 1), ("a", 1), (None, 2)], "c string, n int")
    model = Pipeline(stages=features.one_hot_stages(["c", "n"])).fit(train)
    test = spark.createDataFrame([("a", 1), ("b", 2), (None, 1), ("z", 9)], "c string, n int")
    coded = model.transform(test).select(vector_to_array("c_onehot"), vector_to_array("n_onehot"))
    assert [(list(c), list(n)) for c, n in coded.collect()] == [
        ([1, 0, 0], [1, 0]),
        ([0, 1, 0], [0, 1]),
        ([0, 0, 1], [1, 0]),
        ([0, 0, 0], [0, 0]),
    ]
    text = spark.createDataFrame([("NaN", NAN), (None, 1.0)], "c string, x double")
    assert [tuple(r) for r in features.constant_impute(text, ["c", "x"]).collect()] == [("NaN", "missing"), ("missing", "1.0")]
    filled = features.constant_impute(test, ["c", "n"]).collect()
    assert [tuple(r) for r in filled] == [("a", "1"), ("b", "2"), ("missing", "1"), ("z", "9")]


def test_slots_of_200_000_levels(spark):
    """The index is a table; one hot level holds a third of the rows; an unknown level is slot 0."""
    rows = spark.range(300_000).selectExpr("IF(id % 3 = 0, 'hot', concat('level ', lpad(id, 6, '0'))) AS c", "id")
    model = features.LevelIndexer(inputCols=["c"], outputCols=["slot"]).fit(rows)
    assert model.sizes(spark) == [200_001]
    coded = model.transform(rows)
    assert "Python" not in plan_of(coded)
    found = coded.filter("id IN (0, 1, 2, 299999)").select("id", "slot").collect()
    assert {tuple(r) for r in found} == {(0, 1), (1, 2), (2, 3), (299999, 200_001)}
    assert coded.filter("slot = 1").count() == 100_000
    assert model.transform(spark.createDataFrame([("new",), (None,)], "c string")).agg(F.max("slot")).first()[0] == 0


def test_preprocessing_saves_and_loads(spark):
    rows = [trip(passengers=float(i), distance=i / 2, fare=5.0 + i) for i in range(1, 9)]
    df = built(spark, *rows)
    model = features.preprocessing(features.NUMERIC_FEATURES, features.CATEGORICAL_FEATURES).fit(df)
    path = fresh_path(spark, "preprocessing")
    model.save(path)
    loaded = PipelineModel.load(path)
    before = [r["features"] for r in model.transform(df).collect()]
    assert before == [r["features"] for r in loaded.transform(df).collect()]
    assert before[0].size == 6 + 4
