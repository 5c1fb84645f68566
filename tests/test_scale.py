"""Shuffles that must not grow faster than the tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import history, metrics, postings, rollup
from shelfwise.plans.catalog import QUERIES
from shelfwise.sources import fixtures, tables
from shelfwise.sources.scratch import scratch_dir
from tests.test_rollup import SCHEMA


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).select((F.col("id") % 40).alias("l_suppkey"), (F.col("id") % 77).alias("l_partkey"), F.lit(dt.date(2024, 1, 1)).alias("l_shipdate"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert fixtures.sale_tasks(spark, str(tmp_path)) is None  # Spark's own number will do
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100)
    assert fixtures.sale_tasks(spark, str(tmp_path)) == 40
    stock = fixtures.inventory(spark, str(tmp_path))
    assert stock.rdd.getNumPartitions() == 40 and stock.count() == 3 * rows.select("l_suppkey", "l_partkey").distinct().count()


@pytest.mark.parametrize("name", ["product_catalog_dedup", "fulltext_search", "search_onhand_join"])
def test_the_catalog_is_grouped_in_tasks_by_rows(spark, tmp_path, monkeypatch, capsys, name):
    n, day = F.col("id"), F.lit(dt.date(2024, 1, 1)).alias("l_shipdate")
    made = {
        "lineitem": spark.range(4000).select(
            (n % 40).alias("l_suppkey"), (n % 77).alias("l_partkey"), day, F.lit(1.0).alias("l_quantity"),
            F.lit(9.5).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"), F.lit("R").alias("l_returnflag")),
        "part": spark.range(77).select(
            n.alias("p_partkey"), F.concat(F.lit("cold ring bolt weather "), n).alias("p_name"), F.lit("t").alias("p_type"),
            F.lit("b").alias("p_brand"), (n + 900.0).alias("p_retailprice"), (n % 5).alias("p_size")),
        "supplier": spark.range(40).select(n.alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(0).alias("s_nationkey")),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'n' AS n_name, 0 AS n_regionkey"),
        "region": spark.sql("SELECT 0 AS r_regionkey, 'r' AS r_name"),
    }
    for table, rows in made.items():
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
    plain = QUERIES[name].run(spark, str(tmp_path)).collect()
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100)
    got = QUERIES[name].run(spark, str(tmp_path))
    shuffles = [x for x in plan_of(got, capsys).splitlines() if "Exchange hashpartitioning(product_id" in x]
    assert len(shuffles) == 1 and ", 40), REPARTITION_BY_NUM" in shuffles[0]
    assert sorted(got.collect()) == sorted(plain) and len(plain) == (10 if name == "fulltext_search" else 77)


def test_rollup_base_in_tasks(spark, capsys):
    df = spark.createDataFrame([], SCHEMA)
    assert ", 40), REPARTITION_BY_NUM" in plan_of(metrics.rollup_base(df, 40), capsys)


def test_changes_cancel_in_one_shuffle(spark, capsys):
    old = spark.createDataFrame([(1, None), (1, None), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, None), (2, "B"), (3, "c"), (3, "c"), (3, "c")], "k long, v string")
    got = rollup.changes_between(old, new)
    assert plan_of(got, capsys).count("Exchange hashpartitioning") == 1
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, None, -1), (2, "b", -1), (2, "B", 1), (3, "c", 1), (3, "c", 1)]))


def test_a_timeline_is_shuffled_once(spark, capsys):
    kinds = "from_store_id long, to_store_id long, product_id long, initiated_date date"
    stock = spark.createDataFrame([], "store_id long, product_id long, snapshot_date date, on_hand_units int")
    sales = spark.createDataFrame([], "store_id long, product_id long, sale_date date, units_sold int")
    plan = plan_of(history.move_features(spark.createDataFrame([], kinds), stock, sales, tasks=7), capsys)
    assert "hashpartitioning(store_id" in plan and ", day" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


@pytest.mark.parametrize("text", ["b a b, c B", "a", "", None, "12 !"])
def test_terms_are_counted_in_the_row(spark, text):
    index = postings.build(spark.createDataFrame([(1, text)], "id long, text string"), "id", F.col("text"), scratch_dir(spark, "one"))
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    assert {(r.term, r.tf, r.length) for r in index.postings.collect()} == {(w, words.count(w), len(words)) for w in words}
    assert index.corpus.first().n == 1


def test_a_document_that_comes_twice_counts_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a")], "id long, text string")
    index = postings.build(docs, "id", F.col("text"), scratch_dir(spark, "twice"))
    assert {(r.doc, r.term, r.tf) for r in index.postings.collect()} == {(1, "a", 2), (1, "b", 2), (2, "a", 1)}
    assert index.postings.count() == 3
