"""Parquet sources: datasets as views, optional tables, typed text, ranking text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A dimension is broadcast only up to this many rows; above it the join shuffles.
BROADCAST_ROWS = 200_000

# Above this many rows for each core, a shuffle gets more tasks than Spark's own number.
ROWS_PER_TASK = 1_000_000

NUMERIC_TEXT = r"^-?\d+(\.\d+)?$"

MOVE_RANKING = "array<struct<move:string,recaptured:double,net:double,cost:double>>"


def load(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Register each parquet dataset as a temp view and return the frames by name."""
    frames = {name: spark.read.parquet(path) for name, path in paths.items()}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return frames


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: name and rows. Parquet answers the counts from its footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("dataset"), "row_count")
        for name, df in frames.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


def optional_table(spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
    """The table if it exists, else no rows with the schema it should have."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def broadcast_within(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the known row count is within the limit."""
    return F.broadcast(df) if rows <= limit else df


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks of ROWS_PER_TASK rows; None while Spark's own number, at least one for each core, will do."""
    wanted = -(-rows // ROWS_PER_TASK)
    return wanted if wanted > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """The rows by key in so many tasks. The number of shuffle partitions is fixed for a session, so that
    without this the memory of a task grows with the table."""
    return df.repartition(tasks, *keys) if tasks else df


def parse_move_ranking(text: Column) -> Column:
    """JSON text to an array of moves; bad JSON, a non-array and NULL become an empty array."""
    empty = F.array().cast(MOVE_RANKING)
    parsed = F.from_json(text, MOVE_RANKING, {"mode": "PERMISSIVE"})
    is_array = F.trim(text).startswith("[")
    moves = F.filter(F.coalesce(parsed, empty), lambda m: m.isNotNull())
    return F.when(is_array, moves).otherwise(empty)


def numeric_or_null(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double"))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Turn every all-numeric text column into numbers; other columns stay text. One pass
    decides for all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    verdict = df.agg(
        *[
            F.coalesce(F.bool_and(F.col(c).rlike(NUMERIC_TEXT)), F.lit(False)).alias(c)
            for c in texts
        ]
    ).first()
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts if verdict[c]})


def run_sql(spark: SparkSession, text: str, args: dict) -> DataFrame:
    """SQL with bound parameters; IDENTIFIER(:name) takes a table name."""
    return spark.sql(text, args=args)
