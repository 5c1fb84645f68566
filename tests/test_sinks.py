"""Sinks: what a filter reads of a Z-ordered table, and versions that replace each other."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfwise.sources import sinks
from shelfwise.sources.scratch import scratch_dir
from tests.scans import rows_scanned


def test_z_order_prunes_on_every_key(spark):
    rows = spark.range(60_000).select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)).alias("product_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(700)).cast("int")).alias("sale_date"),
        F.col("id"),
    )
    back = sinks.save_z_ordered(rows, scratch_dir(spark, "z"), ["product_id", "sale_date"], files=36)
    assert back.count() == 60_000
    for where in ("product_id = 1234", "sale_date = DATE'2020-09-09'", "product_id BETWEEN 10 AND 40"):
        found = back.where(where)
        assert found.count() == rows.where(where).count() > 0
        assert rows_scanned(found) <= 60_000 / 3  # of 36 files, about six in a row or column
    both = back.where("product_id BETWEEN 1000 AND 1100 AND sale_date BETWEEN DATE'2020-03-01' AND DATE'2020-03-20'")
    assert rows_scanned(both) <= 60_000 / 8


def test_z_order_of_uneven_and_missing_keys(spark):
    rows = spark.createDataFrame([(k if k % 3 else None, 7, f"r{k}") for k in range(300)], "a long, b int, c string")
    back = sinks.save_z_ordered(rows, scratch_dir(spark, "z"), ["a", "b"], files=4)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    empty = sinks.save_z_ordered(rows.limit(0), scratch_dir(spark, "z"), ["a", "b"])
    assert empty.count() == 0


def test_versions_replace_and_failures_leave(spark):
    path = scratch_dir(spark, "target")
    with pytest.raises(ValueError):
        sinks.read_current(spark, path)
    frame = lambda *keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string")
    sinks.replace_version(frame(1, 2), path, ["k"])
    sinks.replace_version(frame(2, 3, 4), path, ["k"])
    assert sorted(r.k for r in sinks.read_current(spark, path).collect()) == [2, 3, 4]
    with pytest.raises(ValueError):
        sinks.replace_version(frame(5, 5), path, ["k"])
    assert sorted(r.k for r in sinks.read_current(spark, path).collect()) == [2, 3, 4]
    sinks.replace_version(frame(9), path, ["k"])
    assert [r.k for r in sinks.read_current(spark, path).collect()] == [9]
