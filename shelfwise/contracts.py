"""Output contracts: one short spec names, orders, types and rounds the result columns.

A spec is a space-separated list of ``name:kind``. Kinds: ``i`` whole number, ``s`` text,
``d`` date as ISO text, ``t`` timestamp as text with microseconds, ``b`` boolean, and a digit
``n`` for a double rounded to n places. The same spec shapes a DataFrame and a SQL text, so
both sides of a comparison agree on names and types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def _column(name: str, kind: str) -> Column:
    col = F.col(name)
    if kind == "i":
        out = col.cast("bigint")
    elif kind == "s":
        out = col.cast("string")
    elif kind == "d":
        out = F.date_format(col.cast("date"), "yyyy-MM-dd")
    elif kind == "t":
        out = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif kind == "b":
        out = col.cast("boolean")
    else:
        out = F.round(col, int(kind)).cast("double") + F.lit(0.0)
    return out.alias(name)


def _sql(name: str, kind: str) -> str:
    name = f'"{name}"'
    if kind == "i":
        out = f"CAST({name} AS BIGINT)"
    elif kind == "s":
        out = f"CAST({name} AS VARCHAR)"
    elif kind == "d":
        out = f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
    elif kind == "t":
        out = f"strftime(CAST({name} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f')"
    elif kind == "b":
        out = f"CAST({name} AS BOOLEAN)"
    else:
        out = f"CAST(ROUND({name}, {int(kind)}) AS DOUBLE) + CAST(0 AS DOUBLE)"
    return f"{out} AS {name}"


def shape(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[_column(n, k) for n, k in parse(spec)])


def shape_sql(spec: str, body: str) -> str:
    columns = ", ".join(_sql(n, k) for n, k in parse(spec))
    return f"SELECT {columns} FROM ({body}) AS result_rows"
