"""Sales dashboard aggregates over ``sale_date, region, category, sales, profit``.

Amounts are decimals, so sums do not depend on the order in which tasks finish.
Where a result needs a total over its own groups, the groups are written first;
as a subquery the total would run the whole aggregation a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.sources.shared import written


def filter_sales(
    sales: DataFrame, regions: Sequence[str] | None = None, categories: Sequence[str] | None = None
) -> DataFrame:
    """Rows of the chosen regions and categories; ``None`` keeps all."""
    if regions is not None:
        sales = sales.filter(F.col("region").isin(list(regions)))
    if categories is not None:
        sales = sales.filter(F.col("category").isin(list(categories)))
    return sales


def daily_sales(sales: DataFrame) -> DataFrame:
    """Sales per day, in day order."""
    return (
        sales.groupBy("sale_date")
        .agg(F.sum("sales").cast("double").alias("sales"))
        .orderBy("sale_date")
    )


def profit_share(sales: DataFrame) -> DataFrame:
    """Profit per category and its share of the whole profit."""
    per_category = sales.groupBy("category").agg(F.sum("profit").alias("profit"))
    per_category = written(per_category, "category_profit")
    whole = per_category.agg(F.sum("profit").cast("double").alias("profit")).scalar()
    profit = F.col("profit").cast("double")
    return per_category.select(
        "category", profit.alias("profit"), F.try_divide(profit, whole).alias("share")
    )


def underperforming_regions(sales: DataFrame) -> DataFrame:
    """Regions that sell less than the mean region."""
    per_region = sales.groupBy("region").agg(F.sum("sales").cast("double").alias("sales"))
    per_region = written(per_region, "region_sales")
    mean = per_region.agg(F.avg("sales").alias("sales")).scalar()
    return per_region.filter(F.col("sales") < mean)


def high_margin_categories(sales: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` categories with the highest profit per sales."""
    return (
        sales.groupBy("category")
        .agg(F.sum("profit").cast("double").alias("profit"), F.sum("sales").cast("double").alias("sales"))
        .select("category", F.try_divide("profit", "sales").alias("margin"))
        .orderBy(F.col("margin").desc_nulls_last(), "category")
        .limit(k)
    )
