"""Near-duplicate vectors beside all pairs in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import vector_dups

SCHEMA = "vec_id long, vector array<double>, label int, unit string, cls string"


def plain(rows, similarity=0.93):
    """vec_id, n_links, component_id, kept of each row, from all pairs."""
    good = [
        k for k, (_, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(good):
        for b in good[:n]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(v) / max(map(abs, v)) for v in (rows[a][1], rows[b][1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= similarity:
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    root[top(a)] = top(b)
    least: dict = {}
    for k, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            least[top(k)] = min(vec_id, least.get(top(k), vec_id))
    return [(r[0], links[k], least.get(top(k)), r[0] == least.get(top(k))) for k, r in enumerate(rows)]


def as_rows(frame):
    return sorted(map(repr, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect())))


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)


def near(draw, centre, noise):
    return (centre + noise * draw.standard_normal(len(centre))).tolist()


def test_links_and_components(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(k, draw.standard_normal(16).tolist(), k % 3) for k in range(150)]
    centre = draw.standard_normal(16) * 2
    for k in range(150, 260):  # groups that straddle the threshold, and tight ones
        rows.append((k, near(draw, centre, (0.05, 0.4, 0.8)[k % 3]), 1))
    rows += [(k, near(draw, centre, 0.05), 2) for k in range(260, 300)]
    rows += [rows[3], (rows[3][0] + 1000, rows[3][1], rows[3][2]), (1001, [3 * x for x in rows[3][1]], rows[3][2])]
    rows += [
        (2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan"), *[1.0] * 15], 1), (2003, [None, *[1.0] * 15], 1),
        (2004, [float("inf")] * 16, 1), (2005, [], 1), (2006, rows[160][1], None), (None, rows[161][1], 1), (2008, [1.0, 2.0], 1),
        (2009, [2.0, 4.1], 1), (2010, [1e200] * 16, 0), (2011, [1e-200] * 16, 0), (2012, [-1.0] * 16, 0), (None, None, None),
    ]
    want = sorted(map(repr, plain(rows)))
    frame = made(spark, rows)
    assert as_rows(vector_dups.near_duplicates(frame)) == want
    # small cores and blocks: the proofs by angles, the open pairs and the block pairs all occur
    monkeypatch.setattr(vector_dups, "CORE", 4)
    monkeypatch.setattr(vector_dups, "BLOCK", 16)
    assert as_rows(vector_dups.near_duplicates(frame)) == want


def test_recall_at_the_threshold(spark):
    draw = np.random.default_rng(8)
    rows = []
    for k in range(400):  # pairs just above the threshold, and just below
        one = draw.standard_normal(48)
        side = draw.standard_normal(48)
        side -= (one @ side) / (one @ one) * one
        side *= np.linalg.norm(one) / np.linalg.norm(side)
        cosine = 0.9301 if k % 2 else 0.9299
        rows += [(2 * k, one.tolist(), 0), (2 * k + 1, (cosine * one + np.sqrt(1 - cosine**2) * side).tolist(), 0)]
    got = vector_dups.near_duplicates(made(spark, rows)).agg(F.sum("n_links")).first()[0]
    assert 0.99 * 400 <= got <= 400


@pytest.mark.parametrize("width", [2, 8, 64, 128, 1024])
def test_fast_transform(width):
    plain_matrix = np.ones((1, 1))
    while len(plain_matrix) < width:
        plain_matrix = np.block([[plain_matrix, plain_matrix], [plain_matrix, -plain_matrix]])
    x = np.random.default_rng(0).standard_normal((5, width))
    assert np.allclose(vector_dups.hadamard(x), x @ plain_matrix)


def test_tables_grow_with_the_rows():
    few, many = vector_dups.choose_tables(100, 64), vector_dups.choose_tables(1_000_000, 64)
    assert many[0] > few[0] and many[1] > few[1]


def test_empty_and_unusable_tables(spark):
    frame = made(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)])
    assert vector_dups.near_duplicates(frame.limit(0)).count() == 0
    assert as_rows(vector_dups.near_duplicates(frame)) == [repr((1, 1, 1, True))] * 2
    assert as_rows(vector_dups.near_duplicates(made(spark, [(5, None, 1), (6, [1.0], None)]))) == [
        repr((5, 0, 5, True)), repr((6, 0, 6, True)),
    ]
