"""Structured Streaming jobs over the tables, run until the backlog is done; and the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import history, learned, silver
from shelfwise.plans.action_queries import OPEN, WORST
from shelfwise.plans.frames import Retail
from shelfwise.plans.registry import query
from shelfwise.sources import fixtures as fx
from shelfwise.sources.scratch import scratch_dir, stage
from shelfwise.streaming import calls, changes, decisions, intervals, refresh, runner


def call_stream(r: Retail) -> DataFrame:
    """The call log as a stream over the events file."""
    events = runner.stream_files(r.spark, r.sf_dir, r.table("events").schema, only="events.parquet")
    return fx.call_log_columns(events.withColumn("ts", F.col("ts").cast("timestamp")))


def landed_in_turn(r: Retail, df: DataFrame, name: str, turn: Column, turns: int, path: str | None = None) -> list[DataFrame]:
    """Land a frame in one pass, a folder for each turn (from 0; NULL: 0) and in it as many files as
    Spark has tasks. Streams of the first folder, the first two and so on: run one after the other
    from the same checkpoint, each finds the rows of its turn."""
    path = path or scratch_dir(r.spark, name)
    nth = F.greatest(F.lit(0), F.least(F.coalesce(turn, F.lit(0)), F.lit(turns - 1))).cast("int")
    df.limit(0).write.parquet(f"{path}/turn=0")  # a folder that is there without rows, too
    df.withColumn("turn", nth).write.mode("append").partitionBy("turn").parquet(path)
    past = [",".join(map(str, range(n + 1))) for n in range(turns)]
    return [runner.stream_files(r.spark, f"{path}/turn={{{some}}}", df.schema) for some in past]


def by_range(df: DataFrame, place: Column, turns: int) -> Column:
    """The turn of a row, by equal ranges of a number."""
    ends = df.select(place.cast("double").alias("p")).agg(F.min("p").alias("low"), F.max("p").alias("high")).first()
    low, high = ends.low or 0.0, ends.high or 0.0
    width = (high - low) / turns or 1.0
    return F.floor((place.cast("double") - low) / width)


# a window is final once the newest call is ten minutes past its end
_FINAL = "(SELECT MAX(request_time) FROM gateway_log) - INTERVAL 10 MINUTE"


@query("stream_outcomes_per_minute", "minute:t outcome:s n:i",
       f"""SELECT date_trunc('minute', request_time) AS minute, outcome, COUNT(*) AS n FROM call_outcomes
GROUP BY 1, 2 HAVING date_trunc('minute', request_time) + INTERVAL 1 MINUTE <= {_FINAL}""")
def stream_outcomes_per_minute(r: Retail) -> DataFrame:
    return runner.append_to_table(calls.outcomes_per_minute(call_stream(r)), "outcomes")


@query("stream_rate_limit", "window_start:t calls:i refused:i",
       f"""SELECT date_trunc('minute', request_time) AS window_start, COUNT(*) AS calls, COUNT(*) - 2 AS refused
FROM gateway_log GROUP BY 1 HAVING COUNT(*) > 2
  AND date_trunc('minute', request_time) + INTERVAL 1 MINUTE <= {_FINAL}""")
def stream_rate_limit(r: Retail) -> DataFrame:
    return runner.append_to_table(calls.windows_over_limit(call_stream(r), 2, []), "rate-limit")


@query("stream_rate_limit_decisions", "event_id:i requester:s window_start:t allowed:b",
       """SELECT *, ROW_NUMBER() OVER (PARTITION BY requester, window_start ORDER BY request_time, event_id) <= 1 AS allowed
FROM (SELECT *, date_trunc('hour', request_time) AS window_start FROM gateway_log) AS placed""")
def stream_rate_limit_decisions(r: Retail) -> DataFrame:
    """Every call, decided as it comes. Calls come up to nine minutes out of order, and every
    eleventh comes again half an hour later."""
    calls_made = r.gateway_log.select("event_id", F.col("request_time").cast("timestamp").alias("request_time"), "requester")
    seconds = F.unix_seconds("request_time") + F.col("event_id") % 10 * 60
    first = calls_made.withColumn("_arrival", seconds)
    again = first.where(F.col("event_id") % 11 == 0).withColumn("_arrival", F.col("_arrival") + 1800)
    both = first.unionByName(again)
    feeds = landed_in_turn(r, both, "calls", by_range(both, F.col("_arrival"), 4), 4)
    made = [decisions.decisions(feed.drop("_arrival"), 1, ["requester"], "hour", lateness="2 hours") for feed in feeds]
    return decisions.decided(runner.append_to_table(made, "decisions"))


@query("stream_changelog_apply", "id:i lsn:i change_ts:t change_type:s status:s",
       """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY lsn DESC, sort_by DESC) AS rn
FROM changelog WHERE change_type <> 'update_preimage') AS newest WHERE rn = 1 AND change_type <> 'delete'""")
def stream_changelog_apply(r: Retail) -> DataFrame:
    feeds = landed_in_turn(r, r.changelog, "changes", by_range(r.changelog, F.col("lsn"), 3), 3)
    return changes.current_rows(runner.upsert_log([changes.newest_images(feed) for feed in feeds], "current"))


@query("stream_changelog_history", "id:i lsn:i status:s valid_from:t valid_to:t is_current:b",
       """SELECT *, valid_to IS NULL AS is_current FROM (
  SELECT id, lsn, status, change_type, change_ts AS valid_from,
    LEAD(change_ts) OVER (PARTITION BY id ORDER BY lsn, sort_by) AS valid_to
  FROM changelog WHERE change_type <> 'update_preimage') AS intervals WHERE change_type <> 'delete'""")
def stream_changelog_history(r: Retail) -> DataFrame:
    """Changes come in no order; the stream keeps the intervals and corrects them."""
    feeds = landed_in_turn(r, r.changelog, "changes", F.pmod(F.xxhash64("lsn"), F.lit(3)), 3)
    log = runner.append_to_table([intervals.interval_log(feed, lsn_per_bucket=1_000) for feed in feeds], "intervals")
    return intervals.intervals(log)


def _turn(r: Retail, date: str) -> Column:
    """2 for the newest day and later, 1 and 0 for the days before, 0 for all older ones."""
    return 2 - F.least(F.greatest(F.datediff(r.newest, date), F.lit(0)), F.lit(2))


def sales_by_day(r: Retail) -> list[DataFrame]:
    """Sales as streams of three turns: all up to two days before the newest, then day by day."""
    return landed_in_turn(r, r.sales, "sales", _turn(r, "sale_date"), 3)


# columns of silver inventory that a position's status and exposure are made of
_STOCK = ["store_id", "product_id", "snapshot_date", "on_hand_units", "price_usd", "markdown_risk_score"]


def mirrors_by_day(r: Retail, name: str) -> DataFrame:
    tasks = fx.sale_tasks(r.spark, r.sf_dir)
    inventory = silver.silver_inventory(r.inventory, r.stores, r.products, tasks=tasks).select(*_STOCK)
    return refresh.keep_mirror(sales_by_day(r), inventory, name, tasks=tasks)


@query("stream_shortfall_refresh",
       "store_id:i product_id:i on_hand_units:i recent_units_7d:i lost_sales_exposure_usd:2 position_status:s",
       f"SELECT * FROM positions WHERE {OPEN}")
def stream_shortfall_refresh(r: Retail) -> DataFrame:
    """The mirror after the last day."""
    mirrors = mirrors_by_day(r, "mirror")
    return mirrors.where(F.col("as_of") == mirrors.agg(F.max("as_of")).scalar())


def _mirror(back: int) -> str:
    return f"""SELECT CAST(snapshot_date AS DATE) AS as_of, store_id, product_id, on_hand_units, recent_units_7d,
  lost_sales_exposure_usd, position_status FROM positions_{back}_day WHERE {OPEN}"""


@query("stream_daily_mirror",
       "as_of:d store_id:i product_id:i on_hand_units:i recent_units_7d:i lost_sales_exposure_usd:2 position_status:s",
       " UNION ALL ".join(_mirror(back) for back in range(3)))
def stream_daily_mirror(r: Retail) -> DataFrame:
    """The mirrors after each of the last three days: sales leave the sums as days pass."""
    return mirrors_by_day(r, "mirrors")


def _scored(back: int) -> str:
    """The expected event of the snapshot ``back`` days before the newest."""
    rows = f"FROM positions_{back}_day WHERE {OPEN}"
    return f"""SELECT * FROM (SELECT snapshot_date AS scored_date, store_id, product_id, lost_sales_exposure_usd AS worst_exposure_usd,
  (SELECT COUNT(*) {rows}) AS open_shortfall_count,
  (SELECT SUM(lost_sales_exposure_usd) {rows}) AS open_exposure_usd {rows} {WORST} LIMIT 1) AS worst_{back}"""


@query("stream_view_scored",
       "scored_date:d store_id:i product_id:i worst_exposure_usd:2 open_shortfall_count:i open_exposure_usd:2",
       " UNION ALL ".join(_scored(back) for back in range(3)))
def stream_view_scored(r: Retail) -> DataFrame:
    """One event per whole snapshot; snapshots and sales come as two streams, a day at a time. Each
    feed ends with a row of a later day for no store, as the next day's rows would say that the day
    before is over."""

    def feeds(df: DataFrame, name: str, date: str, path: str | None = None) -> list[DataFrame]:
        # a key that no store has: a NULL would be filtered out before the watermark sees its date
        marks = {date: F.date_add(r.newest, 9), "store_id": F.lit(-1), "product_id": F.lit(-1)}
        later = [marks.get(c, F.lit(None)).cast(kind) for c, kind in df.dtypes]
        ended = df.unionByName(df.limit(1).select(*[x.alias(c) for x, c in zip(later, df.columns, strict=True)]))
        return landed_in_turn(r, ended, name, _turn(r, date), 3, path)

    path = scratch_dir(r.spark, "snapshots")
    landed = feeds(r.inventory, "snapshots", "snapshot_date", path)
    # the mark is later than any snapshot
    first = r.spark.read.schema(r.inventory.schema).parquet(path).agg(F.min("snapshot_date")).first()[0]
    events = []
    for snapshots, sales in zip(landed, feeds(r.sales, "sales", "sale_date"), strict=True):
        inventory = silver.silver_inventory(refresh.closing(snapshots), r.stores, r.products, keep=["closes"])
        events.append(refresh.scored_snapshots(inventory, sales, since=F.lit(first)))
    return runner.append_to_table(events, "view-scored")


@query("recovery_model",
       "store_id:i product_id:i move_type:s predicted_recaptured_usd:2 predicted_net_value_usd:2 move_rank:i")
def recovery_model(r: Retail) -> DataFrame:
    moves = history.move_features(r.silver_transfers, fx.stock_history(r.sales), r.sales, tasks=fx.sale_tasks(r.spark, r.sf_dir))
    # every training pass reads the written rows, not the joins and windows behind them
    model = learned.train(stage(learned.training_rows(moves), "training-rows"))
    return learned.score(model, learned.candidates(r.recommended, r.products))


_VALUE = "units_moved * CAST(price_usd AS DOUBLE)"
_CUT = "(SELECT MAX(initiated_date) - 365 FROM transfer_outcomes)"


@query("recovery_model_errors", "move_type:s moves:i mean_usd:2 rate_error:2 model_is_close:b model_is_better:b",
       f"""SELECT move_type, COUNT(*) AS moves, AVG(recaptured_sales_usd) AS mean_usd,
  AVG(ABS(rate * {_VALUE} - recaptured_sales_usd)) AS rate_error, TRUE AS model_is_close,
  CASE WHEN move_type IS NULL THEN TRUE END AS model_is_better
FROM transfer_outcomes JOIN (
  SELECT move_type, AVG(recaptured_sales_usd / NULLIF({_VALUE}, 0)) AS rate FROM transfer_outcomes
  WHERE initiated_date <= {_CUT} GROUP BY move_type) AS rates USING (move_type)
WHERE initiated_date > {_CUT} GROUP BY ROLLUP (move_type)""")
def recovery_model_errors(r: Retail) -> DataFrame:
    """The model and the plain rates on the last year's moves, learned from those before. Close:
    within 2 % of the mean of the rates' error, or better. Better is judged over all moves."""
    moves = history.move_features(r.silver_transfers, fx.stock_history(r.sales), r.sales, tasks=fx.sale_tasks(r.spark, r.sf_dir))
    rows = stage(learned.training_rows(moves, ["initiated_date"]), "training-rows")
    since = F.date_sub(rows.agg(F.max("initiated_date")).scalar(), 365)
    found = learned.later_errors(rows, "initiated_date", since)
    close = F.col("model_error") <= F.col("rate_error") + 0.02 * F.col("mean_usd")
    return found.withColumn("model_is_close", close).withColumn(
        "model_is_better", F.when(F.col("move_type").isNull(), F.col("model_error") < F.col("rate_error"))
    )
