"""Sketched distinct counts beside exact ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import sketches


def test_ranges_of_days(spark):
    rows = spark.range(200_000).select(
        F.expr("DATE'2024-01-01'").cast("date").alias("start"), F.col("id"), (F.col("id") % 30).cast("int").alias("n")
    )
    rows = rows.select(F.date_add("start", F.col("n")).alias("day"), (F.col("id") * 7 % 60_000).alias("user"), (F.col("id") % 12).alias("shop"))
    days = sketches.daily_sketches(rows, F.col("day"), ["user", "shop"])
    assert days.count() == 30
    for low, high in ((1, 30), (5, 9), (14, 14)):
        some = F.dayofmonth("day").between(low, high)
        got = sketches.united(days.where(some), ["user", "shop"]).first()
        want = rows.where(some).agg(F.countDistinct("user").alias("user"), F.countDistinct("shop").alias("shop"), F.count("*").alias("n")).first()
        assert abs(got.user - want.user) <= 0.02 * want.user
        assert (got.shop, got.n_rows) == (want.shop, want.n)


def test_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("2024-01-01", None), ("2024-01-01", "a"), (None, "b")], "day string, user string")
    days = sketches.daily_sketches(rows, F.col("day"), ["user"])
    got = {r.day: r.user for r in sketches.united(days, ["user"], F.col("day"), "day").collect()}
    assert sorted(got.values()) == [1, 1] and None in got
    assert sketches.united(days.limit(0), ["user"]).first().n_rows is None
