"""Shared folder for staged tables, sinks and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_base: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the session names. Only a local session that
    names none gets a temporary folder of this machine."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder every executor can reach")
        if not _local_base:
            _local_base.append(tempfile.mkdtemp(prefix="shelfwise-"))
        base = _local_base[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and lets several branches share the work."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
