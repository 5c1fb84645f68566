"""Sales and snapshots as streams beside the batch positions of each day."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import position
from shelfwise.sources.scratch import scratch_dir
from shelfwise.streaming import refresh, runner

DAY = dt.date(2024, 6, 10)
SALES = "store_id long, product_id long, sale_date date, units_sold int, net_sales_usd decimal(12,2)"
STOCK = "store_id long, product_id long, snapshot_date date, on_hand_units int, price_usd decimal(12,2), markdown_risk_score decimal(2,1)"


def day(n):
    return DAY + dt.timedelta(days=n)


def stream(spark, schema, batches):
    path = scratch_dir(spark, "in-turn")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/batch-{n:02d}")
    return runner.stream_files(spark, f"{path}/batch-*", spark.createDataFrame([], schema).schema, files_per_batch=1)


def sale(store, product, n, units):
    return (store, product, day(n), units, units * 10)


@pytest.fixture
def stock(spark):
    rows = [(s, p, day(n), (s + p + n) % 4 * 5, 20 + p, 0.6) for s in range(3) for p in range(4) for n in range(5)]
    return spark.createDataFrame([(*r[:4], *map(str, r[4:])) for r in rows], STOCK.replace("decimal(12,2)", "string").replace("decimal(2,1)", "string")).select(
        "store_id", "product_id", "snapshot_date", "on_hand_units",
        F.col("price_usd").cast("decimal(12,2)").alias("price_usd"), F.col("markdown_risk_score").cast("decimal(2,1)").alias("markdown_risk_score"),
    )


BATCHES = [
    [sale(0, 0, 0, 5), sale(1, 2, -6, 9), sale(2, 3, -7, 50), sale(0, 1, 0, 2)],
    [sale(0, 0, 1, 7), sale(1, 1, -2, 4)],  # the second comes late, for a day still in the window
    [sale(2, 2, 2, 30), sale(0, 0, 1, 1), sale(1, 1, -1, 3)],
    [sale(0, 3, 4, 8)],
]


def open_rows(spine):
    lost = F.round("lost_sales_exposure_usd", 4).cast("double").alias("lost")
    columns = ["store_id", "product_id", "on_hand_units", "recent_units_7d", lost, "position_status"]
    return sorted(repr(tuple(r)) for r in spine.where(position.is_open()).select(*columns).collect())


def spine_of(spark, stock, arrived, n):
    sales = spark.createDataFrame([(s, p, d, u, str(v)) for s, p, d, u, v in arrived], SALES.replace("decimal(12,2)", "string"))
    sales = sales.withColumn("net_sales_usd", F.col("net_sales_usd").cast("decimal(12,2)"))
    recent = position.recent_sales(sales, as_of=F.lit(day(n)))
    joined = position.join_recent_sales(position.current_snapshot(stock, F.lit(day(n))), recent)
    return position.with_status(position.with_exposures(position.with_metrics(joined)))


def as_decimal(batches):
    from decimal import Decimal

    return [[(*r[:4], Decimal(r[4])) for r in rows] for rows in batches]


def test_mirror_after_each_day(spark, stock):
    mirrors = refresh.keep_mirror(stream(spark, SALES, as_decimal(BATCHES)), stock, "mirror").collect()
    arrived: list = []
    seen = spark.createDataFrame(mirrors)
    for rows, n in zip(BATCHES, (0, 1, 2, 4), strict=True):
        arrived += rows
        assert open_rows(seen.where(F.col("as_of") == F.lit(day(n)))) == open_rows(spine_of(spark, stock, arrived, n))


def test_days_out_of_the_window_leave_the_state(spark):
    batches = as_decimal([[sale(s, 1, 0, 1) for s in range(50)], [sale(0, 1, 30, 1)], [sale(0, 1, 60, 1)], [sale(0, 1, 61, 1)]])
    daily = refresh.daily_sales(stream(spark, SALES, batches))
    running = (
        daily.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", scratch_dir(spark, "daily-checkpoint")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress]
    assert rows[0] == 50 and rows[-1] <= 3


def test_a_backlog_of_years_is_no_state(spark, stock, monkeypatch):
    """A first batch with years of sales leaves no state, and the log holds the last window only."""
    paths = []
    each_batch = runner.each_batch
    monkeypatch.setattr(runner, "each_batch", lambda *a, **k: paths.append(each_batch(*a, **k)) or paths[-1])
    old = [sale(s, p, -7 - n, 1) for s in range(3) for p in range(4) for n in range(30)]
    feed = [old + BATCHES[0], old, *BATCHES[1:]]  # the second batch comes too late as a whole
    mirrors = refresh.keep_mirror(stream(spark, SALES, as_decimal(feed)), stock, "mirror-years")
    arrived = [x for batch in feed for x in batch]
    for n in (0, 1, 2, 4):
        seen = mirrors.where(F.col("as_of") == F.lit(day(n)))
        assert open_rows(seen) == open_rows(spine_of(spark, stock, [x for x in arrived if x[2] <= day(n) and x not in late_for(n)], n))
    logged = spark.read.parquet(f"{paths[0]}/daily")
    assert logged.where(F.col("batch_id") == 0).agg(F.min("sale_date")).first()[0] > day(-7)
    base = paths[0].rsplit("/", 1)[0]
    found = glob.glob(f"{base}/mirror-years-checkpoint-*")
    assert len(found) == 1 and not os.path.exists(f"{found[0]}/state")


def late_for(n):
    """Sales that come in a batch after the mirror of a day."""
    return [x for batch, newest in zip(BATCHES, (0, 1, 2, 4), strict=True) for x in batch if newest > n]


def test_the_snapshot_meets_the_sales_in_tasks(spark, stock, capsys):
    log = spark.createDataFrame(as_decimal([BATCHES[0]])[0], SALES).select(
        "store_id", "product_id", F.col("units_sold").cast("long").alias("units"), F.col("net_sales_usd").alias("net_sales"), "sale_date"
    )
    one, more = (refresh.refreshed_positions(stock, log, tasks) for tasks in (None, 37))
    capsys.readouterr()
    more.explain()
    assert "37), REPARTITION_BY_NUM" in capsys.readouterr().out
    assert sorted(map(repr, one.collect())) == sorted(map(repr, more.collect()))


def test_one_event_per_whole_snapshot(spark, stock):
    end = [(-1, -1, day(20), 0, 0)]
    sales = stream(spark, SALES, as_decimal([BATCHES[0] + BATCHES[1][1:], [BATCHES[1][0]], [BATCHES[2][0], BATCHES[2][1]], end]))
    snapshots = [[tuple(r) for r in stock.where(F.col("snapshot_date") == F.lit(day(n))).collect()] for n in range(3)]
    last = [(-1, -1, day(20), 0, None, None)]
    inventory = refresh.closing(stream(spark, STOCK, [*snapshots, last]))
    got = runner.append_to_table(refresh.scored_snapshots(inventory, sales), "events").collect()
    arrived = BATCHES[0] + BATCHES[1] + BATCHES[2][:2]
    assert sorted(r.scored_date for r in got) == [day(0), day(1), day(2)]
    for r in got:
        n = (r.scored_date - DAY).days
        rows = spine_of(spark, stock, [x for x in arrived if x[2] <= day(n)], n).where(position.is_open())
        rows = rows.orderBy(F.desc("lost_sales_exposure_usd"), "store_id", "product_id").collect()
        assert r.open_shortfall_count == len(rows)
        assert (r.store_id, r.product_id) == ((rows[0].store_id, rows[0].product_id) if rows else (None, None))


def test_old_sales_stay_out_of_the_state(spark, stock):
    """Sales that no snapshot's window holds pass through no state; the events are the same."""
    old = [(s, p, day(-400 - n), 1, 10) for s in range(3) for p in range(4) for n in range(30)]
    last_sale, last_stock = (-1, -1, day(20), 0, 0), (-1, -1, day(20), 0, None, None)
    rows = [tuple(r) for r in stock.where(F.col("snapshot_date") <= F.lit(day(2))).collect()]

    def events(since):
        sales = stream(spark, SALES, as_decimal([old + BATCHES[0] + BATCHES[1] + BATCHES[2], [last_sale]]))
        inventory = refresh.closing(stream(spark, STOCK, [rows, [last_stock]]))
        return refresh.scored_snapshots(inventory, sales, since=since)

    def state(since):
        running = (
            events(since).writeStream.format("noop").option("checkpointLocation", scratch_dir(spark, "since-checkpoint"))
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
        return max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in running.recentProgress)

    first = F.lit(day(0))
    scored = [sorted(map(tuple, runner.append_to_table(events(s), "events").collect())) for s in (None, first)]
    assert len(scored[0]) == 3 and scored[0] == scored[1]
    assert state(first) < state(None) / 4


def test_a_snapshot_waits_packed(spark):
    """Its rows wait as pieces in the join's state, whose number does not grow with them; each still meets its own sums."""
    spread = "id div 100 AS store_id", "id % 100 AS product_id"
    rows = spark.range(4000).selectExpr(*spread, f"DATE'{day(0)}' AS snapshot_date", "0 AS on_hand_units", "CAST(2 AS DECIMAL(12,2)) AS price_usd", "CAST(0.6 AS DECIMAL(2,1)) AS markdown_risk_score")
    last = [(-1, -1, day(20), 0, None, None)]
    path = scratch_dir(spark, "snapshots")
    rows.unionByName(rows.where("product_id = 7")).write.parquet(f"{path}/batch-00")  # the rows of a product come twice
    spark.createDataFrame(last, STOCK).write.parquet(f"{path}/batch-01")
    inventory = refresh.closing(runner.stream_files(spark, f"{path}/batch-*", rows.schema))
    sales = stream(spark, SALES, as_decimal([[sale(s, p, 0, 7) for s in range(40) for p in (7, 8)], [sale(-1, -1, 20, 0)]]))
    out = scratch_dir(spark, "events")
    running = (
        refresh.scored_snapshots(inventory, sales).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_dir(spark, "packed-checkpoint")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    held = [s["numRowsTotal"] for p in running.recentProgress for s in p["stateOperators"] if s["operatorName"] == "symmetricHashJoin"]
    assert 0 < max(held) <= 3 * refresh.PIECES
    event = spark.read.parquet(out).collect()
    assert [(r.scored_date, r.store_id, r.product_id, r.open_shortfall_count) for r in event] == [(day(0), 0, 7, 120)]
    assert event[0].open_exposure_usd == 120 * 60
