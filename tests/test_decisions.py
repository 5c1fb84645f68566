"""Rate limit decisions of a stream beside the batch ranks over the whole log."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import gateway
from shelfwise.sources.scratch import scratch_dir
from shelfwise.streaming import decisions, runner

SCHEMA = "event_id long, request_time timestamp, requester string"
START = dt.datetime(2024, 5, 1, 9, 0)


def call(event_id, seconds, requester):
    return (event_id, START + dt.timedelta(seconds=seconds), requester)


def feed(spark, batches):
    """One file per batch, read one by one in this order."""
    path = scratch_dir(spark, "calls")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/part={n:02d}")
    return runner.stream_files(spark, f"{path}/*", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def check(spark, batches, limit, keys):
    log = runner.append_to_table(decisions.decisions(feed(spark, batches), limit, keys), "decisions")
    final = decisions.decided(log).collect()
    whole = spark.createDataFrame([r for b in batches for r in b], SCHEMA).distinct()
    refused = {r.event_id for r in gateway.refused_calls(whole, limit, keys).collect()}
    assert {r.event_id for r in final} == {r[0] for b in batches for r in b}
    assert {r.event_id for r in final if not r.allowed} == refused
    return log


@pytest.mark.parametrize("keys", [["requester"], []])
def test_late_and_repeated_calls(spark, keys):
    batches = [
        [call(1, 30, "a"), call(2, 31, "a"), call(3, 32, "a"), call(4, 70, "a"), call(5, 5, "b")],
        [call(6, 10, "a"), call(2, 31, "a"), call(7, 6, "b")],  # 6 takes the place of 2; 2 comes twice
        [call(8, 1, "a"), call(9, 71, "a"), call(5, 5, "b"), call(10, 31, "a")],  # 8 that of 1
        [call(11, 71, "a"), call(12, 200, "b")],  # equal times: the smaller id first
    ]
    log = check(spark, batches, 2, keys)
    assert log.filter("event_id = 2").count() == (2 if keys else 1)  # first allowed, then corrected


def test_a_hot_requester_keeps_a_small_state(spark):
    hot = [call(k, (k * 37) % 120, "hot") for k in range(4000)]
    rest = [call(10_000 + k, (k * 53) % 120, f"user{k % 30}") for k in range(400)]
    rows = sorted([*hot, *rest], key=lambda r: (r[0] * 7919) % 1009)
    log = check(spark, [rows[k::4] for k in range(4)], 3, ["requester"])
    assert log.count() <= 4400 + 4 * 3 * 31 * 2  # corrections are few: a window's places, once a batch


def test_state_of_passed_windows_goes(spark):
    batches = [[call(k, k, "a") for k in range(5)], [call(100, 5000, "a")], [call(101, 9000, "b")], [call(102, 12000, "b")]]
    path = scratch_dir(spark, "log")
    stream = decisions.decisions(feed(spark, batches), 1, ["requester"])
    running = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", scratch_dir(spark, "log-checkpoint")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    rows = [s["numRowsTotal"] for p in running.recentProgress for s in p["stateOperators"] if "dedupe" not in s["operatorName"]]
    assert rows and rows[-1] <= 2
    assert spark.read.parquet(path).filter(F.col("allowed")).count() == 4


def test_keys_of_a_window_share_a_state(spark):
    """A state for each key would cost a call to Python for nearly every call; NULL is a key, too."""
    rows = [call(k, k % 50, f"user{k}" if k % 9 else None) for k in range(500)]
    running = (
        decisions.decisions(feed(spark, [rows]), 1, ["requester"]).writeStream.format("noop")
        .option("checkpointLocation", scratch_dir(spark, "log-checkpoint")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    states = [s["numRowsTotal"] for s in running.recentProgress[0]["stateOperators"] if "dedupe" not in s["operatorName"]]
    assert states and max(states) <= decisions.SHARDS
    log = runner.append_to_table(decisions.decisions(feed(spark, [rows]), 1, ["requester"]), "nulls")
    allowed = decisions.decided(log).where(F.col("allowed")).collect()
    assert len(allowed) == len({r[2] for r in rows}) and [r.event_id for r in allowed if r.requester is None] == [0]
