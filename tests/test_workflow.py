"""Approvals, conversations, change feed, history and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfwise.operators import actions as act
from shelfwise.operators import changelog, chat, gateway, history
from shelfwise.sources.scratch import scratch_dir
from shelfwise.streaming import calls, changes, runner

def at():
    return F.lit("2026-08-27 13:16:19").cast("timestamp")


def test_approval_with_hold_and_event(spark):
    made = spark.createDataFrame(
        [(214, 4412, "transfer", 228, 377, "Transfer 228", 50073.76, "ops"), (5, 1, "expedite", 3, None, "x", 9.0, "ops")],
        "store_id long, product_id long, move_type string, units long, source_store_id long, "
        "drafted_request string, predicted_recaptured_usd double, user_email string",
    )
    rows = act.apply_approvals(made, at()).collect()
    assert len(rows) == 3
    hold = next(r for r in rows if r["move_type"] == "markdown_hold")
    assert (hold["store_id"], hold["source_store_id"], hold["units"]) == (377, 214, 0)
    assert hold["drafted_request"] == "Markdown hold on surplus feeding 214 transfer"
    events = act.decision_events(made, at()).select(
        "action_id", F.get_json_object("payload", "$.markdown_hold_id").alias("h")).collect()
    assert {e["action_id"] for e in events} == {r["id"] for r in rows} - {hold["id"]}
    assert {e["h"] for e in events} == {hold["id"], None}


FEED = [
    (1, 121126616, 0, "2026-08-27 12:32:36.419", "insert", "APPROVED"),
    (2, 121126616, 1, "2026-08-27 12:32:36.419", "insert", "DRAFT"),
    (2, 121183312, 5, "2026-08-27 12:34:18.535", "update_preimage", "DRAFT"),
    (2, 121183312, 6, "2026-08-27 12:34:18.537", "update_postimage", "APPROVED"),
    (3, 121183313, 0, "2026-08-27 12:35:00.000", "insert", "DRAFT"),
    (3, 121183314, 0, "2026-08-27 12:36:00.000", "delete", "DRAFT"),
]
FEED_SCHEMA = "id long, lsn long, sort_by long, change_ts string, change_type string, status string"


def feed(spark, rows=FEED):
    return spark.createDataFrame(rows, FEED_SCHEMA).withColumn("change_ts", F.col("change_ts").cast("timestamp"))


def test_change_feed(spark):
    now = {r["id"]: r["status"] for r in changelog.current_state(feed(spark)).collect()}
    assert now == {1: "APPROVED", 2: "APPROVED"}
    rows = changelog.history(feed(spark), lsn_per_bucket=1000).orderBy("id", "valid_from").collect()
    assert [(r["id"], r["status"], r["is_current"]) for r in rows] == [
        (1, "APPROVED", True), (2, "DRAFT", False), (2, "APPROVED", True), (3, "DRAFT", False),
    ]
    assert rows[1]["valid_to"] == rows[2]["valid_from"]


def test_change_stream_ignores_late_older_changes(spark):
    path = scratch_dir(spark, "late")
    late = sorted(FEED, key=lambda r: -r[1])  # newest file lands first
    for i, part in enumerate((late[:2], late[2:])):
        feed(spark, part).coalesce(1).write.mode("append").parquet(path)
    stream = runner.stream_files(spark, path, feed(spark).schema, files_per_batch=1)
    now = changes.current_rows(runner.upsert_log(changes.newest_images(stream), "late-log"))
    assert {r["id"]: r["status"] for r in now.collect()} == {1: "APPROVED", 2: "APPROVED"}


def test_rate_limit_stream_and_batch(spark):
    start = dt.datetime(2026, 8, 28, 5, 40)
    rows = [(i, start + dt.timedelta(seconds=10 * i), "u") for i in range(12)]
    rows.append((99, start + dt.timedelta(hours=1), "u"))
    log = spark.createDataFrame(rows, "event_id long, request_time timestamp, requester string")
    path = scratch_dir(spark, "log")
    log.write.parquet(path)
    stream = runner.stream_files(spark, path, log.schema)
    out = runner.append_to_table(calls.windows_over_limit(stream, 2, ["requester"]), "limits")
    batch = gateway.windows_over_limit(log, 2, ["requester"])
    assert sorted((r["window_start"], r["refused"]) for r in out.collect()) == sorted(
        (r["window_start"], r["refused"]) for r in batch.collect())
    refused = gateway.refused_calls(log, 2, ["requester"])
    assert sorted(r["event_id"] for r in refused.collect()) == [2, 3, 4, 5, 8, 9, 10, 11]


def test_positions_go_on_after_the_last(spark):
    old = spark.createDataFrame([(1, 0), (1, 1)], "conversation_id long, position long")
    new = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7)], "conversation_id long, arrival long")
    got = chat.append_positions(old, new, "arrival")
    one = got.where("conversation_id = 1")
    assert one.where(F.col("position") != F.col("arrival") + 2).count() == 0
    assert got.where("conversation_id = 2").first()["position"] == 0


def test_long_conversation_nests_in_pages(spark):
    heads = spark.createDataFrame([(1, "t")], "conversation_id long, title string")
    messages = spark.range(450).selectExpr("1L AS conversation_id", "id AS position", "'user' AS role", "'x' AS content")
    sizes = chat.with_messages(heads, messages).selectExpr("size(messages) AS n").collect()
    assert sorted(r["n"] for r in sizes) == [50, 200, 200]


def test_delete_needs_the_owner(spark):
    heads = spark.createDataFrame([("a", 1), ("b", 2)], "user_email string, conversation_id long")
    messages = spark.createDataFrame([(1,), (2,), (2,)], "conversation_id long")
    asked = spark.createDataFrame([("a", 1), ("a", 2)], "user_email string, conversation_id long")
    left = chat.cascade_delete(asked, heads, messages, messages)
    assert {n: df.count() for n, df in left.items()} == {"conversations": 1, "messages": 2, "feedback": 2}


def test_move_features(spark):
    day = dt.date(2026, 8, 10)
    moves = spark.createDataFrame([(1, 2, 5, day), (None, 2, 5, day), (1, 2, 5, dt.date(2026, 8, 1))],
                                  "from_store_id long, to_store_id long, product_id long, initiated_date date")
    stock = spark.createDataFrame([(1, 5, dt.date(2026, 8, 9), 40), (1, 5, dt.date(2026, 8, 5), 90), (1, 5, dt.date(2026, 8, 11), 7)],
                                  "store_id long, product_id long, snapshot_date date, on_hand_units int")
    sold = [(2, 5, day, 100), (2, 5, dt.date(2026, 8, 9), 7), (2, 5, dt.date(2026, 8, 3), 14), (2, 5, dt.date(2026, 8, 2), 100)]
    sales = spark.createDataFrame(sold, "store_id long, product_id long, sale_date date, units_sold int")
    got = {(r["from_store_id"], r["initiated_date"]): (r["from_on_hand_at_move"], r["to_velocity_at_move"])
           for r in history.move_features(moves, stock, sales).collect()}
    assert got == {(1, day): (40, 3.0), (None, day): (None, 3.0), (1, dt.date(2026, 8, 1)): (None, 0.0)}


def test_grid_fills_gaps(spark):
    sales = spark.createDataFrame([(1, 1, dt.date(2026, 8, 3), 4), (1, 1, dt.date(2026, 8, 1), 2), (2, 9, dt.date(2026, 8, 3), 1)],
                                  "store_id long, product_id long, sale_date date, units_sold int")
    pairs = sales.where("store_id = 1")
    rows = history.daily_grid(pairs, sales, 4).orderBy("sale_date").collect()
    assert [r["units_sold"] for r in rows] == [0, 2, 0, 4]


def test_status_transition_leaves_stale_rows(spark):
    actions = spark.createDataFrame([("a", "proposed", None), ("b", "approved", "x"), ("c", "proposed", None)],
                                    "id string, status string, approved_by string")
    asked = spark.createDataFrame([("a", "proposed", "approved", "lead"), ("b", "proposed", "approved", "lead")],
                                  "id string, expected string, wanted string, by string")
    got = {r["id"]: (r["status"], r["approved_by"]) for r in act.transition(actions, asked).collect()}
    assert got == {"a": ("approved", "lead"), "b": ("approved", "x"), "c": ("proposed", None)}
