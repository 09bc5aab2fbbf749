"""Trip features and the preprocessing stages of the tip classifier.

The preprocessing stages are Spark ML estimators, so they compose in a
``Pipeline`` and are fitted on the training rows only.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwise.functions.timeparts import monday_based_day, pickup_hour
from tripwise.operators.profiles import PICKUP, above
from tripwise.operators.ranks import BINS, numbered, values_at_ranks
from tripwise.sources.shared import written
from tripwise.sources.tables import blank_nan

# The features of the tip model.
NUMERIC_FEATURES = [
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "total_amount",
    "pickup_hour",
    "pickup_dayofweek",
]
CATEGORICAL_FEATURES = ["VendorID", "RatecodeID", "store_and_fwd_flag", "payment_type"]
TARGET = "high_tip"
HIGH_TIP_RATE = 0.25
MISSING = "missing"

# The fare is the divisor of the label and the total contains the tip.
LEAKY_FEATURES = ["fare_amount", "total_amount"]

def with_pickup_parts(df: DataFrame, ts: str = PICKUP) -> DataFrame:
    """Add pickup hour and day of week (0 = Monday)."""
    return df.withColumns({"pickup_hour": pickup_hour(ts), "pickup_dayofweek": monday_based_day(ts)})


def trip_features(
    df: DataFrame, ts: str = PICKUP, threshold: float = HIGH_TIP_RATE, drop_null_tip: bool = False
) -> DataFrame:
    """Valid trips with hour, day of week, tip rate and the ``high_tip`` label, in one narrow pass.

    A trip without a tip amount is kept with label 0 unless ``drop_null_tip``.
    """
    if dict(df.dtypes)[ts] == "string":
        df = df.withColumn(ts, F.col(ts).try_cast("timestamp_ntz"))
    kept = df.filter(
        F.col(ts).isNotNull()
        & above("fare_amount", 0.0)
        & above("trip_distance", 0.0, inclusive=True)
        & above("passenger_count", 0.0)
    )
    kept = blank_nan(kept, ["tip_amount", "total_amount"])
    if drop_null_tip:
        kept = kept.na.drop(subset=["tip_amount"])
    rated = with_pickup_parts(kept, ts).withColumn(
        "tip_rate", F.try_divide("tip_amount", "fare_amount")
    )
    label = F.coalesce(F.col("tip_rate") >= F.lit(float(threshold)), F.lit(False)).cast("int")
    return rated.withColumn(TARGET, label)


def model_input(features: DataFrame, key: str | None = None, exclude_leaky: bool = False) -> DataFrame:
    """Feature and label columns of the rows in which all of them are present."""
    names = feature_names(exclude_leaky)
    kept = [key] if key else []
    return features.na.drop(subset=[*names, TARGET]).select(*kept, *names, TARGET)


def feature_names(exclude_leaky: bool = False) -> list[str]:
    names = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    return [n for n in names if n not in LEAKY_FEATURES] if exclude_leaky else names


def exact_medians(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, float]:
    """Exact medians (mean of the two middle values for an even count), null and NaN left out.

    Spark's ``median`` keeps every distinct value of a column in one task; the
    rank search does not. A column without values has no entry in the result.
    """
    middles = values_at_ranks(df, {c: lambda n: {(n - 1) // 2, n // 2} for c in columns}, bins)
    return {c: min(found.values()) / 2 + max(found.values()) / 2 for c, found in middles.items()}


class _PerColumn(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted numbers per column, applied as literals: a projection without a join."""

    centers = Param(Params._dummy(), "centers", "one number per column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "one number per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, centers=None, scales=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def fitted(self) -> dict[str, float]:
        return dict(zip(self.getInputCols(), self.getOrDefault(self.centers)))


class MedianImputerModel(_PerColumn):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = {}
        names = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.centers))
        for source, target, median in names:
            value = F.col(source).cast("double")
            filled[target] = F.coalesce(F.when(~F.isnan(value), value), F.lit(median))
        return dataset.withColumns(filled)


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Null and NaN become the exact median of the fitted rows."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        columns = self.getInputCols()
        medians = exact_medians(dataset, columns)
        empty = [c for c in columns if c not in medians]
        if empty:
            raise ValueError(f"No value to take a median of: {empty}")
        return MedianImputerModel(
            inputCols=columns,
            outputCols=self.getOutputCols(),
            centers=[medians[c] for c in columns],
            scales=[],
        )


class PopulationScalerModel(_PerColumn):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = {}
        names = zip(
            self.getInputCols(),
            self.getOutputCols(),
            self.getOrDefault(self.centers),
            self.getOrDefault(self.scales),
        )
        for source, target, mean, scale in names:
            scaled[target] = (F.col(source).cast("double") - F.lit(mean)) / F.lit(scale)
        return dataset.withColumns(scaled)


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Zero mean and unit population deviation; a constant column is only centred."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        columns = self.getInputCols()
        stats = []
        for i, c in enumerate(columns):
            value = F.col(c).cast("double")
            value = F.when(~F.isnan(value), value)
            stats += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
        row = dataset.agg(*stats).first()
        return PopulationScalerModel(
            inputCols=columns,
            outputCols=self.getOutputCols(),
            centers=[row[f"m{i}"] or 0.0 for i in range(len(columns))],
            scales=[row[f"s{i}"] or 1.0 for i in range(len(columns))],
        )


def filled_text(df: DataFrame, column: str) -> Column:
    """A category as text, with null, and NaN of a numeric column, as their own category."""
    value = F.col(column)
    if dict(df.dtypes)[column] in ("double", "float"):
        value = F.when(~F.isnan(value), value)
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def constant_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: filled_text(df, c) for c in columns})


def level_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, level, slot`` of the levels of each column, slots from 1 in the order of the levels' text.

    A written table: levels are combined before the shuffle and numbered by range partition, so no
    column's levels meet on the driver or in one task.
    """
    named = [F.struct(F.lit(c).alias("feature"), filled_text(df, c).alias("level")) for c in columns]
    levels = df.select(F.explode(F.array(*named)).alias("named")).select("named.*").distinct()
    return written(numbered(levels, ["level"], ["feature"], "slot"), "level_index")


class LevelIndexModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds each category's slot, 0 for a level that was not fitted, by a join with the written index.

    Spark broadcasts an index whose files are small and shuffles for a larger one.
    """

    path = Param(Params._dummy(), "path", "folder of the index", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, path=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def levels(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.getOrDefault(self.path))

    def sizes(self, spark: SparkSession) -> list[int]:
        """Number of fitted levels of each column."""
        counted = self.levels(spark).groupBy("feature").agg(F.max("slot").alias("n")).collect()
        found = {r["feature"]: r["n"] for r in counted}
        return [found.get(c, 0) for c in self.getInputCols()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        levels = self.levels(dataset.sparkSession)
        for source, target in zip(self.getInputCols(), self.getOutputCols()):
            of_column = levels.filter(F.col("feature") == source).select(
                F.col("level").alias("_level"), F.col("slot").alias("_slot")
            )
            joined = dataset.join(of_column, filled_text(dataset, source) == F.col("_level"), "left")
            slot = F.coalesce("_slot", F.lit(0)).cast("int")
            dataset = joined.withColumn(target, slot).drop("_level", "_slot")
        return dataset


class LevelIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers the levels of the fitted rows in the order of their text."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LevelIndexModel:
        columns = self.getInputCols()
        levels = level_index(dataset, columns)
        return LevelIndexModel(inputCols=columns, outputCols=self.getOutputCols(), path=levels.written_to)


class SlotVectorsModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Slots as sparse vectors of the fitted lengths; slot 0 is a vector of zeros."""

    sizes = Param(Params._dummy(), "sizes", "length of each vector", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, sizes=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, sizes = self.getInputCols(), self.getOrDefault(self.sizes)
        # The encoder takes its lengths from a row of largest indices; what lies beyond is all zeros.
        index = [F.when(F.col(c) > 0, F.col(c) - 1).otherwise(F.lit(max(n, 1))).cast("double") for c, n in zip(names, sizes)]
        columns = [f"{c}_at" for c in names]
        widest = dataset.sparkSession.createDataFrame([[float(max(n, 1) - 1) for n in sizes]], columns)
        encoder = OneHotEncoder(
            inputCols=columns, outputCols=self.getOutputCols(), dropLast=True, handleInvalid="keep"
        ).fit(widest)
        return encoder.transform(dataset.withColumns(dict(zip(columns, index)))).drop(*columns)


class SlotVectors(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot vectors of slots, as long as the largest fitted slot."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SlotVectorsModel:
        columns = self.getInputCols()
        row = dataset.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in columns]).first()
        return SlotVectorsModel(
            inputCols=columns, outputCols=self.getOutputCols(), sizes=[int(row[c]) for c in columns]
        )


def one_hot_stages(columns: list[str]) -> list:
    """Level -> slot in alphabetical order -> sparse one-hot vector.

    A level that was not seen in training becomes slot 0 and all zeros.
    """
    slots = [f"{c}_slot" for c in columns]
    return [
        LevelIndexer(inputCols=columns, outputCols=slots),
        SlotVectors(inputCols=slots, outputCols=[f"{c}_onehot" for c in columns]),
    ]


def preprocessing(numeric: list[str], categorical: list[str], output: str = "features") -> Pipeline:
    """Median fill and scaling for numbers, one-hot for categories, joined in one vector."""
    return Pipeline(
        stages=[
            MedianImputer(inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric]),
            PopulationScaler(
                inputCols=[f"{c}_filled" for c in numeric],
                outputCols=[f"{c}_scaled" for c in numeric],
            ),
            *one_hot_stages(categorical),
            VectorAssembler(
                inputCols=[f"{c}_scaled" for c in numeric] + [f"{c}_onehot" for c in categorical],
                outputCol=output,
            ),
        ]
    )
