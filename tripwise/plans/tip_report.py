"""Distribution of tip rates and share of high tips, with an export of the processed trips."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.operators.features import TARGET, trip_features
from tripwise.operators.profiles import histogram, value_counts
from tripwise.operators.sampling import sample_exact
from tripwise.sources.sinks import write_table


@dataclass
class TipReport:
    processed: DataFrame
    tip_rates: DataFrame
    high_tips: DataFrame


def report_tips(
    trips: DataFrame,
    key: str,
    sample_size: int | None = None,
    bins: int = 30,
    seed: int = 42,
    export_path: str | None = None,
) -> TipReport:
    """Process all trips, or an exact random sample of them.

    The export is written in parallel, as a folder of headed CSV (or Parquet) files.
    """
    if sample_size is not None:
        trips = sample_exact(trips, key, sample_size, seed)
    processed = trip_features(trips)
    if export_path:
        write_table(processed, export_path)
    return TipReport(
        processed=processed,
        tip_rates=histogram(processed, F.coalesce("tip_rate", F.lit(0.0)), bins),
        high_tips=value_counts(processed, TARGET),
    )
