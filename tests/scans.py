"""How many rows the file scans of a frame gave, read off its plan after it has run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def rows_scanned(df: DataFrame) -> int:
    df.collect()
    return _rows(df._jdf.queryExecution().executedPlan())


def _rows(plan) -> int:
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _rows(plan.plan())
    if name == "FileSourceScanExec":
        return int(plan.metrics().apply("numOutputRows").value())
    children = plan.children()
    return sum(_rows(children.apply(k)) for k in range(children.size()))
