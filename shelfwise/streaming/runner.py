"""Run a streaming query over what is there and hand back its output table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from shelfwise.sources.scratch import scratch_dir

BATCH_BYTES = 4 << 20  # of an Arrow batch between Spark and Python


def stream_files(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None, only: str | None = None
) -> DataFrame:
    """A stream over the parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return reader.parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Rows can hold megabytes: an Arrow batch takes about BATCH_BYTES of them. A smaller bound that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) << (10 * " kmgt".index(unit or " ")) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def trigger_of(every: str | None) -> dict:
    """Repeat at an interval, or without one work off the backlog and stop."""
    return {"processingTime": every} if every else {"availableNow": True}


def turns_of(stream: DataFrame | list[DataFrame]) -> list[DataFrame]:
    """One stream, or one for each turn of what arrives."""
    return stream if isinstance(stream, list) else [stream]


def run_in_turn(streams: list[DataFrame], name: str, every: str | None, sink: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Run a query to its end; with several streams, go on with the next from the same checkpoint."""
    checkpoint = scratch_dir(streams[0].sparkSession, f"{name}-checkpoint")
    for stream in streams:
        sink(stream).option("checkpointLocation", checkpoint).trigger(**trigger_of(every)).start().awaitTermination()


def append_to_table(stream: DataFrame | list[DataFrame], name: str, every: str | None = None) -> DataFrame:
    """Append the finished rows of a stream to a parquet table (exactly once). A list holds the same
    query over more and more folders; its parts run in turn."""
    streams = turns_of(stream)
    spark = streams[0].sparkSession
    path = scratch_dir(spark, name)
    run_in_turn(
        streams, name, every, lambda s: s.writeStream.format("parquet").outputMode("append").option("path", path)
    )
    return spark.read.schema(streams[0].schema).parquet(path)


def each_batch(
    stream: DataFrame | list[DataFrame], name: str, work: Callable[[DataFrame, int, str], None], mode: str,
    every: str | None = None,
) -> str:
    """Call ``work(batch, batch_id, folder)`` per micro-batch; returns the folder. The work writes
    below ``batch_id=N`` with overwrite, so a repeated batch replaces its own output."""
    streams = turns_of(stream)
    path = scratch_dir(streams[0].sparkSession, name)

    def handle(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id, f"{path}/batch_id={batch_id}")

    run_in_turn(streams, name, every, lambda s: s.writeStream.foreachBatch(handle).outputMode(mode))
    return path


def upsert_log(stream: DataFrame | list[DataFrame], name: str, every: str | None = None) -> DataFrame:
    """Write the rows each micro-batch changed, marked with its batch_id. The newest batch of a
    key holds its value."""

    def work(batch: DataFrame, batch_id: int, folder: str) -> None:
        batch.write.mode("overwrite").parquet(folder)

    path = each_batch(stream, name, work, "update", every)
    first = turns_of(stream)[0]
    schema = StructType(first.schema.fields).add("batch_id", "long")
    return first.sparkSession.read.schema(schema).parquet(path)
