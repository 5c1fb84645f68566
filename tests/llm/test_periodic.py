"""Periodic runs beside a plain search of every period, and grammar extensions beside plain ones."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import periodic, queries

SCHEMA = "doc_id long, text string, lang string, runs string, words string, n long"


def plain_runs(words):
    best: dict = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            first = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            length = at - first + period
            if at > first and length >= max(12, 2 * period):
                best.setdefault((first, length), period)
            at += at == first
    return sorted((start, length, period) for (start, length), period in best.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=70), min_size=1, max_size=5), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_runs_are_those_of_a_plain_search(texts, period):
    texts = [*texts, [x for t in texts for x in t][:period] * 9]
    for words, runs in zip(texts, periodic.runs_of_texts(texts), strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words)


def test_long_texts():
    draw = np.random.default_rng(4)
    base = [f"w{k}" for k in draw.integers(0, 300, 700)]
    fibonacci = ["a", "b"]
    one, two = ["a"], ["a", "b"]
    while len(two) < 2500:
        one, two = two, two + one
    fibonacci = two
    texts = [base * 3 + base[:50], ["x"] * 3000, fibonacci, base + ["y"] * 30 + base, ["p", "q"] * 600 + base + ["p", "q"] * 600]
    for words, runs in zip(texts, periodic.runs_of_texts(texts), strict=True):
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words)


def test_grammar_extensions():
    draw = np.random.default_rng(2)
    for size in (1, 40, 900):
        words, begins, sizes = periodic.numbered([[str(x) for x in draw.integers(0, 2, size)] * 4, ["z"] * size])
        grammar = periodic.Grammar(words, 2)
        assert len(grammar.symbols[-1]) <= 4 + periodic.FEW
        one = draw.integers(begins[0], begins[0] + sizes[0], 300)
        two = draw.integers(begins[0], begins[1] + sizes[1], 300)
        one, two = one[one != two], two[one != two]
        for a, b, got in zip(one, two, grammar.extension(one, two), strict=True):
            want = 0
            while words[a + want] == words[b + want]:
                want += 1
            assert got == want


def test_candidates_in_small_shares(monkeypatch):
    texts = [[str(x) for x in np.random.default_rng(k).integers(0, 2, 90)] for k in range(5)]
    want = [r.tolist() for r in periodic.runs_of_texts(texts)]
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert [r.tolist() for r in periodic.runs_of_texts(texts)] == want


@pytest.fixture(scope="module")
def docs(spark):
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, 40, n)) for n in draw.integers(0, 160, 120)]
    texts += [None, "", " \t\n", "a", "a  a\ta\x0ba\x0ca\ra\na a a a a a a", "x y " * 40, "x y\u0085z " * 15, "a b c " * 2000, texts[3], texts[3]]
    rows = [(k, t, "en", "r", "w", 7) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "p q r " * 9, None, None, None, None), (None, None, None, None, None, None), (-40, texts[7], "", "", "", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_query_rows(docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(docs.sparkSession, str(tmp_path))
    want = sorted(repr(plain_row(r.doc_id, r.text)) for r in docs.collect())
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
        ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]


def test_operator_rows_and_empty_table(docs):
    for r in periodic.periodic_runs(docs).collect():
        assert r.n_words >= 0 and r.collapsed is not None
        assert all(x.length >= max(12, 2 * x.period) for x in r.runs)
    one = docs.sparkSession.createDataFrame([(1, "a b " * 8 + "c")], "doc_id long, text string")
    row = periodic.periodic_runs(one).first()
    assert [tuple(x) for x in row.runs] == [(0, 16, 2)] and row.collapsed == "a b c" and row.n_words == 17
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
