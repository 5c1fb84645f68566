"""Parquet sinks: full overwrite, clustered by one key or along a Z-curve of several, keyed snapshots and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType, TimestampType

LEVELS = 6  # bits of a key's place on the Z-curve
COMMIT = StructType([StructField("version", LongType()), StructField("folder", StringType())])


def _written(df: DataFrame, path: str, dataset: str) -> DataFrame:
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(dataset).alias("dataset"), "row_count")


def save(df: DataFrame, path: str, dataset: str) -> DataFrame:
    """Overwrite the dataset, read it back and count it."""
    df.write.mode("overwrite").parquet(path)
    return _written(df, path, dataset)


def save_clustered(df: DataFrame, path: str, key: str, tie: list[str]) -> DataFrame:
    """Overwrite in ranges of the common filter key, so that file and row-group statistics
    prune. ``tie`` columns extend the range key: one hot key value then spans several files
    instead of one task. Returns the table as read back."""
    ordered = df.repartitionByRange(key, *tie).sortWithinPartitions(key, *tie)
    ordered.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _as_number(df: DataFrame, key: str) -> Column:
    kind = df.schema[key].dataType
    if isinstance(kind, DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(key).cast("double")
    return F.col(key).cast("double")


def _rank(number: Column, bounds: list[float]) -> Column:
    """How many of the bounds a number has reached; 0 for NULL."""
    every = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    return F.coalesce(F.size(F.filter(every, lambda b: b <= number)), F.lit(0)).cast("long")


def z_place(df: DataFrame, keys: list[str], levels: int = LEVELS) -> Column:
    """Place of a row on a Z-curve over the ranks of its keys (numbers, dates, timestamps; NULL is
    first). Ranks come from approximate quantiles, 2^levels - 1 numbers for each key, so that
    uneven keys are spread evenly."""
    shares = [n / (1 << levels) for n in range(1, 1 << levels)]
    found = df.agg(*[F.percentile_approx(_as_number(df, k), shares, 10_000).alias(k) for k in keys]).first()
    place = F.lit(0).cast("long")
    for nth, key in enumerate(keys):
        rank = _rank(_as_number(df, key), found[key] or [])
        for bit in range(levels):
            place = place.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(keys) + nth))
    return place


def save_z_ordered(df: DataFrame, path: str, keys: list[str], files: int | None = None, levels: int = LEVELS) -> DataFrame:
    """Overwrite along a Z-curve: each file holds a small range of every key, so that a filter on
    any of them skips most files. A crowded place on the curve is split by a hash. Returns the
    table as read back."""
    placed = df.withColumn("_z", z_place(df, keys, levels))
    spread = [F.col("_z"), F.xxhash64(*df.columns)]
    ranged = placed.repartitionByRange(files, *spread) if files else placed.repartitionByRange(*spread)
    ranged.sortWithinPartitions("_z", *keys).drop("_z").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def snapshot(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Write the full source as a new version of the target, whose key must be unique. The key is
    checked on the written rows, so the source is computed once; a version that fails is not
    handed out."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if duplicate_keys(back, key).limit(1).count():
        raise ValueError(f"key {key} is not unique in the source")
    return back


def current_version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The newest committed version of a target and its folder; (0, None) before the first."""
    try:
        commits = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0, None
    newest = commits.agg(F.max_by("folder", "version").alias("folder"), F.max("version").alias("version")).first()
    return newest.version or 0, newest.folder


def replace_version(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Replace the target by the source, whose key must be unique. The source is written beside the
    versions there are and checked; only then a commit names it. A run that fails, at writing or at
    the check, leaves the version before in place. Returns the new version as read back."""
    spark = df.sparkSession
    version = current_version(spark, path)[0] + 1
    folder = f"version-{version:06d}"
    df.write.mode("overwrite").parquet(f"{path}/{folder}")
    back = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    if duplicate_keys(back, key).limit(1).count():
        raise ValueError(f"key {key} is not unique in the source")
    spark.createDataFrame([(version, folder)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return back


def read_current(spark: SparkSession, path: str) -> DataFrame:
    folder = current_version(spark, path)[1]
    if folder is None:
        raise ValueError(f"nothing is committed in {path}")
    return spark.read.parquet(f"{path}/{folder}")
