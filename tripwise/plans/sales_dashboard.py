"""The aggregates behind a sales dashboard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tripwise.operators import sales as ops


@dataclass
class SalesDashboard:
    daily: DataFrame
    profit_share: DataFrame
    underperforming_regions: DataFrame
    high_margin_categories: DataFrame


def build_dashboard(
    sales: DataFrame,
    regions: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    best: int = 3,
) -> SalesDashboard:
    """Daily trend, profit shares, weak regions and best margins of the chosen regions and categories."""
    chosen = ops.filter_sales(sales, regions, categories)
    return SalesDashboard(
        daily=ops.daily_sales(chosen),
        profit_share=ops.profit_share(chosen),
        underperforming_regions=ops.underperforming_regions(chosen),
        high_margin_categories=ops.high_margin_categories(chosen, best),
    )
