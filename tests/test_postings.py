"""Search by postings beside search by scanning every text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import postings, search
from shelfwise.sources.scratch import scratch_dir
from tests.scans import rows_scanned


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(7)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(draw.choices(words, [1 / (n + 1) for n in range(100)], k=draw.randrange(1, 60))) for _ in range(600)]
    texts += ["", None, "zebra zebra ak", "Zebra-AK! 12 bk", "zebra"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, docs):
    return postings.build(docs, "doc_id", F.col("text"), scratch_dir(spark, "index"), block_docs=16, files=8)


def plain(docs, terms):
    scored = search.bm25(search.text_stats(docs, terms), terms).where("bm25 > 0")
    return {r.doc_id: r.bm25 for r in scored.collect()}


@pytest.mark.parametrize("terms", [["zebra"], ["ak", "jt", "zebra"], ["ak", "al", "bk"], ["nowhere"], ["ak", "nowhere"]])
def test_scores_and_best(index, docs, terms):
    want = plain(docs, terms)
    got = {r.doc: r.bm25 for r in postings.bm25(index, terms).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for k in (1, 7, 2000):
        best = sorted(want, key=lambda d: (-round(want[d], 9), d))[:k]
        assert [r.doc for r in postings.bm25_topk(index, terms, k).collect()] == best


@pytest.mark.parametrize("terms", [["zebra"], ["ak", "zebra"], ["ak", "al", "am"], ["ak", "nowhere"], ["bk", "jt"]])
def test_documents_with_every_term(index, docs, terms):
    words = F.col("_words")
    held = docs.withColumn("_words", search.tokens(F.col("text"))).where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(words, t)))
    want = {r.doc_id: (sum(w in terms for w in r._words), float(len(r._words))) for r in held.collect()}
    assert {r.doc: (r.hits, r.length) for r in postings.every_term(index, terms).collect()} == want


def test_only_the_terms_are_read(spark, index):
    total, own = index.postings.count(), postings.of_terms(index.postings, ["jt"])
    assert 0 < rows_scanned(own) <= total / 3  # the file that holds the term, not the others
    assert rows_scanned(postings.of_terms(index.postings, ["nowhere", "zz"])) <= total / 3


def test_empty_corpus(spark, docs):
    empty = postings.build(docs.limit(0), "doc_id", F.col("text"), scratch_dir(spark, "empty"))
    assert postings.bm25(empty, ["ak"]).count() == postings.bm25_topk(empty, ["ak"], 3).count() == 0
    assert postings.every_term(empty, ["ak"]).count() == 0
