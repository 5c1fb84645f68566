"""Session builder for tests, the bench and stand-alone runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(
    app: str = "shelfwise", cores: int | None = None, shared_dir: str | None = None
) -> SparkSession:
    """A local session. A cluster supplies its own; only the SQL settings matter there."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # call-site capture costs a stack walk per column expression while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shared_dir:
        builder = builder.config("spark.checkpoint.dir", shared_dir)
    return builder.getOrCreate()
