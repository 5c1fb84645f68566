"""Spine goldens and edges."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import position as pos

SNAP = (
    "store_id long, store_name string, region string, climate_zone string, city string, store_lat double, "
    "store_lng double, product_id long, product_name string, category string, subcategory string, "
    "seasonality string, on_hand_units int, on_order_units int, price_usd decimal(12,2), "
    "markdown_risk_score decimal(2,1), snapshot_date date"
)


def snapshot_row(product, on_hand, risk="0.1", price="249.00", day="2026-08-24"):
    import datetime

    return (
        1, "s", "West", "North", "Denver", 39.7, -105.0, product, "p", "c", "sub", "cold_weather", on_hand, 0,
        Decimal(price), Decimal(risk), datetime.date.fromisoformat(day),
    )


def build(spark, rows, sales):
    import datetime

    sold = [(1, p, datetime.date.fromisoformat(d), u, Decimal("1.00")) for p, d, u in sales]
    schema = "store_id long, product_id long, sale_date date, units_sold int, net_sales_usd decimal(12,2)"
    out = pos.store_sku_position(spark.createDataFrame(rows, SNAP), spark.createDataFrame(sold, schema))
    return {r["product_id"]: r for r in out.collect()}


def test_goldens_and_edges(spark):
    day = "2026-08-24"
    got = build(
        spark,
        [
            snapshot_row(1, 0), snapshot_row(2, 5), snapshot_row(3, 0), snapshot_row(4, 10),
            snapshot_row(5, 10, "0.6"), snapshot_row(6, 0), snapshot_row(7, 99, day="2026-08-23"),
        ],
        [(1, day, 72), (2, day, 5), (6, day, 53), (6, "2026-08-17", 1000), (6, "2026-08-18", 0)],
    )
    assert set(got) == {1, 2, 3, 4, 5, 6}  # the older snapshot is gone
    assert got[1]["avg_daily_velocity"] == Decimal("10.285714")
    assert round(got[1]["lost_sales_exposure_usd"], 2) == Decimal("76834.28")
    assert got[1]["position_status"] == "stockout"
    # velocity rounds up, so five in stock against five sold is just under a week
    assert got[2]["weeks_of_supply"] < 1
    assert round(float(got[2]["weeks_of_supply"]), 7) == 0.9999996
    assert got[2]["position_status"] == "at_risk"
    assert got[3]["weeks_of_supply"] is None
    assert got[3]["position_status"] == "healthy"
    assert got[3]["lost_sales_exposure_usd"] == 0
    assert got[4]["weeks_of_supply"] == 9999
    assert got[4]["position_status"] == "healthy"
    assert got[5]["position_status"] == "overstock"
    assert got[5]["markdown_exposure_usd"] == Decimal("747")
    # the sale exactly seven days before the newest is outside the window
    assert got[6]["recent_units_7d"] == 53
    assert round(got[6]["lost_sales_exposure_usd"], 2) == Decimal("56558.58") - Decimal("0.01")


def test_as_of_overrides_the_anchor(spark):
    rows = spark.createDataFrame([snapshot_row(1, 3), snapshot_row(2, 4, day="2026-08-23")], SNAP)
    older = pos.current_snapshot(rows, F.lit("2026-08-23").cast("date"))
    assert [r["product_id"] for r in older.collect()] == [2]


@pytest.mark.parametrize("days,kept", [(7, 2), (1, 1)])
def test_trailing_window_excludes_its_bound(spark, days, kept):
    rows = spark.sql(
        "SELECT explode(array(date'2026-08-24', date'2026-08-18', date'2026-08-17')) AS sale_date"
    )
    assert pos.trailing_window(rows, days).count() == kept
