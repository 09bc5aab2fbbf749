import datetime as dt
from decimal import Decimal

import pytest

from tests.plans import plan_of, unpartitioned_windows
from tripwise.catalog import inputs
from tripwise.operators import sales
from tripwise.plans.sales_dashboard import build_dashboard


@pytest.fixture(scope="module")
def rows(spark):
    def row(day, region, category, amount, profit):
        return (dt.date(2024, 1, day), region, category, Decimal(amount), Decimal(profit))

    return spark.createDataFrame(
        [
            row(1, "north", "toys", "10.1000", "5.0000"),
            row(1, "south", "toys", "20.2000", "1.0000"),
            row(2, "south", "food", "69.7000", "2.0000"),
            row(2, "east", "food", "0.0000", "0.0000"),
        ],
        "sale_date date, region string, category string, sales decimal(18,4), profit decimal(18,4)",
    )


def test_daily_sales_and_filters(rows):
    assert [r["sales"] for r in sales.daily_sales(rows).collect()] == [30.3, 69.7]
    kept = sales.filter_sales(rows, ["south"], ["toys"])
    assert [tuple(r) for r in sales.daily_sales(kept).collect()] == [(dt.date(2024, 1, 1), 20.2)]
    assert sales.filter_sales(rows).count() == 4


def test_profit_share(rows):
    shares = {r["category"]: (r["profit"], r["share"]) for r in sales.profit_share(rows).collect()}
    assert shares == {"toys": (6.0, 0.75), "food": (2.0, 0.25)}


def test_regions_below_the_mean_region(rows):
    assert {r["region"] for r in sales.underperforming_regions(rows).collect()} == {"north", "east"}


def test_margins(rows):
    best = sales.high_margin_categories(rows, 1).collect()
    assert [(r["category"], round(r["margin"], 6)) for r in best] == [("toys", round(6 / 30.3, 6))]


def test_dashboard_of_one_region(rows):
    dashboard = build_dashboard(rows, regions=["south"], best=1)
    assert [r["sales"] for r in dashboard.daily.collect()] == [20.2, 69.7]
    assert sum(r["share"] for r in dashboard.profit_share.collect()) == pytest.approx(1.0)
    assert dashboard.underperforming_regions.count() == 0
    assert [r["category"] for r in dashboard.high_margin_categories.collect()] == ["toys"]


def test_only_the_tables_of_the_columns_are_joined(spark):
    sf_dir = "/root/testdata/sf0.001"
    shares = plan_of(inputs.sales(spark, sf_dir, "category", "profit"))
    assert "o_orderkey" not in shares and "p_partkey" in shares
    daily = plan_of(inputs.sales(spark, sf_dir, "sale_date", "sales"))
    assert "p_partkey" not in daily and "c_custkey" not in daily and "o_orderkey" in daily
    assert inputs.sales(spark, sf_dir).columns == list(inputs.SALES_COLUMNS)


def test_sales_plan_has_no_cross_join_and_prunes_columns(spark):
    daily = sales.daily_sales(inputs.sales(spark, "/root/testdata/sf0.001"))
    plan = plan_of(daily, "formatted")
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "l_tax" not in plan
    assert unpartitioned_windows(plan) == 0
