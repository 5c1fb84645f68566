"""Status changes on a kept table rewrite the touched folders only."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from shelfwise.operators import actions
from shelfwise.sources.scratch import scratch_dir


def files(path):
    return {os.path.dirname(f): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/part=*/*.parquet")}


def test_only_touched_folders_change(spark):
    path = scratch_dir(spark, "kept")
    rows = spark.range(500).select(
        F.concat(F.lit("a"), F.col("id")).alias("id"), F.when(F.col("id") % 3 == 0, "proposed").otherwise("approved").alias("status"),
        F.lit(None).cast("string").alias("approved_by"),
    )
    actions.keep_actions(rows, path)
    before = files(path)
    ask = lambda *ids: spark.createDataFrame([(f"a{k}", "proposed", "approved", "lead") for k in ids], "id string, expected string, wanted string, by string")
    actions.transition_in_place(spark, path, ask(3, 4, 9))  # 4 is not proposed, so its folder stays
    after = files(path)
    parts = {r.id: r.p for r in rows.select("id", actions.action_part().alias("p")).collect()}
    touched = {os.path.join(path, f"part={parts[k]}") for k in ("a3", "a9")}
    assert {d for d in before if before[d] != after.get(d)} == touched and before.keys() == after.keys()
    want = actions.transition(rows, ask(3, 4, 9)).drop("changed")
    got = spark.read.parquet(path).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    actions.transition_in_place(spark, path, ask(3, 4, 9))
    assert files(path) == after
    actions.transition_in_place(spark, path, ask())
    assert files(path) == after
