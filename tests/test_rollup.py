"""Rollups kept up by changes beside the measures over all positions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import metrics, rollup
from shelfwise.sources.scratch import scratch_dir

SCHEMA = (
    "climate_zone string, region string, category string, position_status string, product_id long, product_name string, store_id long, "
    "lost_sales_exposure_usd decimal(20,4), markdown_exposure_usd decimal(20,4), on_hand_units int, recent_units_7d long, "
    "recent_net_sales_7d decimal(20,4), weeks_of_supply decimal(38,22), markdown_risk_score decimal(2,1)"
)
EVERY = list(metrics.MEASURES)


def positions(spark, draw, count):
    from decimal import Decimal

    some = lambda: None if draw.random() < 0.2 else Decimal(draw.randrange(10_000)) / 8
    rows = [
        (draw.choice(["North", "South", None]), draw.choice("ab"), draw.choice("xy"), draw.choice(["stockout", "overstock", "healthy"]),
         draw.randrange(5), "p", draw.randrange(4), some(), some(), draw.randrange(9), draw.randrange(9), some(), some(), Decimal(draw.randrange(10)) / 10)
        for _ in range(count)
    ]
    return rows, spark.createDataFrame([*rows, *rows[:5]], SCHEMA)  # some rows twice


def as_rows(df):
    shown = [F.round(c, 6).cast("double").alias(c) if t.startswith(("decimal", "double")) else F.col(c) for c, t in df.dtypes]
    return sorted(map(repr, map(tuple, df.select(*shown).collect())))


@pytest.mark.parametrize("dims", [["climate_zone", "category"], ["region", "position_status"], ["product_id"], []])
def test_after_batches_of_changes(spark, dims):
    draw = random.Random(4)
    fine = rollup.Rollup(spark, scratch_dir(spark, "fine"), tuple(metrics.ROLLUP_DIMENSIONS))
    rows, now = positions(spark, draw, 60)
    fine.start(now)
    for batch in (1, 2):
        rows = [r for r in rows if r[0] != "North" or batch == 1][10:]
        rows = rows + positions(spark, draw, 12)[0]
        after = spark.createDataFrame(rows, SCHEMA)
        changes = rollup.changes_between(now, after)
        fine.add(changes, batch)
        fine.add(changes, batch)  # run again: the part is replaced
        now = after
    want = as_rows(metrics.measure(now, dims, EVERY))
    assert as_rows(fine.measure(dims, EVERY)) == want
    assert as_rows(fine.compacted(scratch_dir(spark, "compact")).measure(dims, EVERY)) == want


def test_groups_that_lost_all_rows_are_gone(spark):
    _, now = positions(spark, random.Random(1), 20)
    kept = rollup.Rollup(spark, scratch_dir(spark, "gone"), ("category",)).start(now)
    kept.add(rollup.changes_between(now, now.where("category = 'x'")), 1)
    assert [r.category for r in kept.rows().collect()] == ["x"]


def test_smallest_rollup_that_holds_the_dimensions(spark):
    _, now = positions(spark, random.Random(2), 80)
    made = lambda *dims: rollup.Rollup(spark, scratch_dir(spark, "some"), dims).start(now)
    fine, coarse, other = made(*metrics.ROLLUP_DIMENSIONS), made("climate_zone", "category"), made("region")
    assert rollup.smallest([fine, coarse, other], ["category"]) is coarse
    assert rollup.smallest([fine, coarse, other], ["product_id"]) is fine
    assert rollup.smallest([fine, coarse, other], []) is other
    with pytest.raises(KeyError):
        rollup.smallest([coarse], ["product_id"])
    with pytest.raises(KeyError):
        coarse.measure(["region"], EVERY)
    assert as_rows(coarse.measure(["category"], EVERY)) == as_rows(metrics.measure(now, ["category"], EVERY))
