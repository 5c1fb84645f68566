"""Registered queries: a name, an output spec, a Spark plan and, where possible, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfwise.contracts import shape, shape_sql
from shelfwise.plans.frames import Retail
from shelfwise.plans.views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    spec: str
    plan: Callable[[Retail], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.plan(Retail(spark, sf_dir)), self.spec)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_views(shape_sql(self.spec, self.sql))


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    """Register the decorated plan under a name."""

    def add(plan: Callable[[Retail], DataFrame]) -> Callable[[Retail], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, spec, plan, sql)
        return plan

    return add
