"""Predict whether a trip gets a high tip."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tripwise.operators.certificates import forest_checks, forest_nodes
from tripwise.operators.features import (
    CATEGORICAL_FEATURES,
    LEAKY_FEATURES,
    NUMERIC_FEATURES,
    TARGET,
    model_input,
    trip_features,
)
from tripwise.operators.metrics import binary_metrics, classification_report, roc_auc
from tripwise.operators.models import score, train_forest
from tripwise.operators.sampling import sample_exact, stratified_split
from tripwise.sources.shared import written

TEST_FRACTION = 0.25
FIT_ROWS = 5_000_000


@dataclass
class TipClassifier:
    """``train`` and ``test`` read one written table of rows with their side, ``predictions`` is
    written too: each metric reads it instead of scoring again."""

    model: PipelineModel
    train: DataFrame
    test: DataFrame
    predictions: DataFrame

    def metrics(self) -> DataFrame:
        area = roc_auc(self.predictions, TARGET).select("roc_auc").scalar()
        return binary_metrics(self.predictions, TARGET).withColumn("roc_auc", area)

    def report(self) -> DataFrame:
        whole = self.predictions.withColumn("prediction", self.predictions["prediction"].cast("int"))
        return classification_report(whole, TARGET)


    def checks(self) -> DataFrame:
        """Whether the nodes of the forest add up, see ``forest_checks``."""
        return forest_checks(forest_nodes(self.model), self.model.stages[-1].getMaxDepth())


def classify_tips(
    trips: DataFrame,
    key: str,
    sample_size: int | None = None,
    test_fraction: float = TEST_FRACTION,
    seed: int = 42,
    num_trees: int = 100,
    max_depth: int = 10,
    exclude_leaky: bool = False,
    drop_null_tip: bool = False,
    fit_rows: int = FIT_ROWS,
) -> TipClassifier:
    """Features, stratified split, training on one side and scoring of the other.

    All trips are used unless ``sample_size`` asks for an exact random sample.
    Of the training side at most ``fit_rows`` random rows are fitted; every row of the
    test side is scored.
    """
    if sample_size is not None:
        trips = sample_exact(trips, key, sample_size, seed)
    rows = model_input(trip_features(trips, drop_null_tip=drop_null_tip), key, exclude_leaky)
    numeric = [c for c in NUMERIC_FEATURES if not (exclude_leaky and c in LEAKY_FEATURES)]
    split = written(stratified_split(written(rows, "model_input"), key, TARGET, test_fraction, seed), "tip_split")
    train = split.filter("split = 'train'").drop("split")
    test = split.filter("split = 'test'").drop("split")
    if train.count() > fit_rows:
        train = written(sample_exact(train, key, fit_rows, seed + 1), "fitted_trips")
    model = train_forest(
        train, key, numeric, CATEGORICAL_FEATURES, TARGET, num_trees, max_depth, seed
    )
    scored = written(score(model, test, [key, TARGET]), "tip_predictions")
    return TipClassifier(model, train, test, scored)
