"""History kept by a stream beside the batch history over the whole feed."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from shelfwise.operators import changelog
from shelfwise.sources.scratch import scratch_dir
from shelfwise.streaming import intervals, runner

SCHEMA = "id long, lsn long, sort_by long, change_ts timestamp, change_type string, status string"
KINDS = ["insert", "update_preimage", "update_postimage", "update_postimage", "delete"]


def feed(spark, batches):
    path = scratch_dir(spark, "changes")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/batch-{n:02d}")
    return runner.stream_files(spark, f"{path}/batch-*", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def changes(count, ids, seed):
    draw = random.Random(seed)
    rows = []
    for lsn in range(count):
        when = None if lsn % 41 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=draw.randrange(10_000), microseconds=lsn)
        rows.append((draw.choice(ids), lsn, lsn % 3, when, draw.choice(KINDS), f"s{lsn % 7}"))
    return rows


@pytest.mark.parametrize("order", ["as logged", "backwards", "mixed"])
def test_any_order_of_arrival(spark, order):
    rows = changes(400, [1, 1, 1, 1, 2, 3, 4, None], 5)  # half of all changes are of one id
    arrived = {"as logged": rows, "backwards": rows[::-1], "mixed": random.Random(2).sample(rows, len(rows))}[order]
    batches = [arrived[k : k + 140] for k in range(0, 400, 140)]
    batches[1] = [*batches[1], *batches[0][:30]]  # delivered again
    log = runner.append_to_table(intervals.interval_log(feed(spark, batches), 32), "intervals")
    got = intervals.intervals(log)
    want = changelog.history(spark.createDataFrame(rows, SCHEMA), lsn_per_bucket=32)
    columns = ["id", "lsn", "sort_by", "change_type", "status", "valid_from", "valid_to", "is_current"]
    as_text = lambda df: sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert as_text(got) == as_text(want)


def test_only_touched_intervals_are_written(spark):
    rows = [(1, lsn, 0, dt.datetime(2024, 1, 1, 0, lsn), "update_postimage", "a") for lsn in range(40)]
    late = (1, 20, 1, dt.datetime(2024, 1, 1, 0, 20, 30), "update_postimage", "late")
    log = runner.append_to_table(intervals.interval_log(feed(spark, [rows, [late]]), 1000), "intervals")
    assert log.count() == 42  # the late image, and one correction
    cut = {r.lsn: r.valid_to for r in intervals.intervals(log).filter("lsn = 20 AND sort_by = 0").collect()}
    assert cut == {20: dt.datetime(2024, 1, 1, 0, 20, 30)}


def test_ids_of_a_bucket_share_a_state(spark):
    """A state for each id would cost a call to Python for nearly every change."""
    rows = [(lsn % 200, lsn, 0, dt.datetime(2024, 1, 1, 0, 0, lsn % 60), "update_postimage", "a") for lsn in range(400)]
    running = (
        intervals.interval_log(feed(spark, [rows]), 1000).writeStream.format("noop")
        .option("checkpointLocation", scratch_dir(spark, "log-checkpoint")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert running.recentProgress[0]["stateOperators"][0]["numRowsTotal"] == 1
