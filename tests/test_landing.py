"""Tables that land in turns and are streamed one turn after the other."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import stream_queries
from shelfwise.streaming import runner


def test_a_turn_lands_in_as_many_files_as_there_are_tasks(spark):
    """A turn in one file would go through one task, however large it is."""
    rows = spark.range(0, 4000, numPartitions=4)
    feeds = stream_queries.landed_in_turn(SimpleNamespace(spark=spark), rows, "rows", F.col("id") % 2, 2)
    path = runner.each_batch(feeds, "turns", lambda batch, n, folder: batch.withColumn("f", F.input_file_name()).write.parquet(folder), "append")
    found = spark.read.option("basePath", path).parquet(path)
    per_batch = {r.batch_id: (r.n, r.files) for r in found.groupBy("batch_id").agg(F.count("id").alias("n"), F.countDistinct("f").alias("files")).collect()}
    assert per_batch == {0: (2000, 4), 1: (2000, 4)}
    assert {r.id % 2 for r in found.where("batch_id = 0").collect()} == {0}


@pytest.mark.parametrize("place", ["id", "NULL", "7"])
def test_no_row_is_lost_between_the_turns(spark, place):
    rows = spark.range(100).withColumn("part", F.lit("a"))
    turn = stream_queries.by_range(rows, F.expr(place), 3)
    feeds = stream_queries.landed_in_turn(SimpleNamespace(spark=spark), rows, "rows", turn, 3)
    assert runner.append_to_table(feeds, "kept").count() == 100
    none = stream_queries.landed_in_turn(SimpleNamespace(spark=spark), rows.limit(0), "none", turn, 3)
    assert runner.append_to_table(none, "none").count() == 0
