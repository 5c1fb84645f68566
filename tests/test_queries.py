"""Every registered query beside its SQL twin on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from check import rows_of
from shelfwise.plans.catalog import QUERIES
from shelfwise.sources.fixtures import TABLES, table_path

SF = "/root/testdata/sf0.001"
SLOW = {"recovery_model"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{table_path(SF, name)}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, duck, name, capsys):
    df = contract.queries()[name](spark, SF)
    df.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = contract.oracle_sql().get(name)
    if sql is not None:
        cursor = duck.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
