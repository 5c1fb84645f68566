"""Vector codes beside plain whole-number clustering, and the tree search beside all entries."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check import rows_of
from shelfwise.llm import queries, vector_codes

SCHEMA = "vec_id long, vector array<double>, label int, code string, error string, total int"


def plain(rows, parts=8, entries=16, rounds=6):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not good:
        return []
    width = -(-max(len(v) for _, v, _ in good) // parts)
    numbers = []
    for vec_id, v, label in good:
        exact = [math.floor(x) * 4096 + math.floor((x - math.floor(x)) * 4096) for x in [*v, *[0.0] * (width * parts - len(v))]]
        numbers.append([exact[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1]))[:entries]
    books = [[numbers[k][p] for k in order] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[near(p, n[p])[1] for n in numbers] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [n[p] for n, c in zip(numbers, chosen[p], strict=True) if c == k]
                if own:
                    books[p][k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    last = [[near(p, n[p]) for p in range(parts)] for n in numbers]
    errors = [min(sum(d for d, _ in row), (1 << 63) - 1) for row in last]
    label = {}
    for r, e in zip(good, errors, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [
        (r[0], "".join(f"{k:02x}" for _, k in row), e, min(label[r[2]], (1 << 63) - 1), sha)
        for r, row, e in zip(good, last, errors, strict=True)
    ]


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", 3) for r in rows], SCHEMA).repartition(3)
    got = vector_codes.vector_codes(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, plain(rows)))


def test_codes_and_errors(spark):
    draw = np.random.default_rng(5)
    rows = [(k, (draw.standard_normal(16) * 0.2).tolist(), k % 3 if k % 7 else None) for k in range(90)]
    rows += [(100 + k, rows[k % 4][1], 1) for k in range(60)]  # many equal parts, so ties
    rows += [(200, None, 1), (201, [float("nan")] * 16, 1), (202, [None] * 16, 0), (203, [float("-inf")] * 16, 2), (204, [0.0] * 16, 5)]
    rows += [(None, rows[2][1], 2), (None, None, None), (3, rows[3][1], 0), (205, [-1e-9, 1e-9] * 8, 5)]
    check(spark, rows)


def test_few_rows_other_lengths_and_large_components(spark):
    check(spark, [(3, [0.5, -0.5, 0.25], 1), (1, [1.0] * 9, None), (2, [], 1), (9, [0.1] * 8, 2)])
    draw = np.random.default_rng(1)
    check(spark, [(k, (draw.standard_normal(8) * 10.0 ** (k % 5 * 9)).tolist(), k % 2) for k in range(40)])


def test_nothing_to_code(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.vector_codes(empty).count() == 0
    check(spark, [(1, None, 1), (2, [float("nan")], 2)])
    check(spark, [(1, [], 1), (2, [], 2)])


@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(0, 9), st.sampled_from([2, 40, 3000]), st.sampled_from([1, 10**25]))
@settings(max_examples=150, deadline=None)
def test_tree_finds_the_nearest(seed, count, width, span, factor):
    draw = np.random.default_rng(seed)
    entries = draw.integers(-span, span, (count, width))[draw.integers(0, count, count)]
    x = draw.integers(-span, span, (50, width))
    if factor > 1:
        entries, x = entries.astype(object) * factor, x.astype(object) * factor
    index, distance = vector_codes.Gnat(entries).nearest(x)
    for row, k, d in zip(x, index, distance, strict=True):
        assert (d, k) == min((((row - e) ** 2).sum(), k) for k, e in enumerate(entries))


def test_tree_rules_out_whole_children():
    draw = np.random.default_rng(0)
    entries = np.concatenate([c + draw.integers(-9, 9, (8, 8)) for c in draw.integers(-9000, 9000, (8, 8))])
    tree = vector_codes.Gnat(entries)
    tree.nearest(entries[draw.integers(0, 64, 1000)] + 1)
    assert tree.met / 1000 < 40


@pytest.mark.parametrize("name", ["op13_vector_codes", "op11_embedding_dedup"])
def test_queries_beside_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    cursor = con.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, cursor.fetchall())
