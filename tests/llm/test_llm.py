"""The training-data operators beside plain Python, on small tables with odd rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwise.llm import ann, bpe, exact_dedup, langid, line_dedup, lm_score, ngram_join, packing, secrets, toxicity
from shelfwise.llm.common import code_points
from shelfwise.llm.words import split_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, kept string"
WORDS = "the river runs over old stones and under a long bridge where people walk slowly home at night".split()


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(draw.integers(0, len(WORDS), n), draw.integers(0, 9, n), strict=True))


def odd_texts() -> list:
    base = prose(1, 80)
    near = base.split()
    near[40] = "changed"
    lines = "\n".join(prose(k, 6) for k in range(20, 25))
    return [
        base, base, base.replace(" ", "  "), " ".join(near), " ".join(near[:-1]), None, "", "   ", "short text", "short text", "a",
        "12 34 !!", prose(2, 60), prose(3, 30_000), lines, f"intro one\n{lines}\nend", f"{lines}\nmore\n\n\n", "\n\n\n\n",
        'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "mail ann12@mail3.example.com and 4785380592391139", "é" * 300,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), 1, "z") for k, t in enumerate(odd_texts())]
    rows += [rows[0], rows[12], (None, prose(9, 50), None, None, None, None, None), (None, "", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    groups: dict = {}
    for r in rows:
        groups.setdefault(hashlib.sha256(normal(r.text).encode()).hexdigest(), []).append(r)
    kept: dict = {}
    for g in got:
        own = groups[g.text_sha256]
        best = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert (g.keep_id, g.group_size) == (best.doc_id, len(own))
        kept[g.text_sha256] = kept.get(g.text_sha256, 0) + g.kept
        assert not g.kept or g.doc_id == g.keep_id
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(normal(r.text) for r in left.collect()) == sorted({normal(r.text) for r in rows})


def test_exact_groups_stay_exact_when_the_filter_is_full(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "filter_bits", lambda rows: 1 << 15)
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == want


def test_nearest(spark):
    draw = np.random.default_rng(0)
    vectors = draw.standard_normal((600, 8)).round(3)
    vectors[100:400] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [None] * 8), (None, [1.0] * 8), (704, []), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = ann.nearest(df, df.filter("vec_id % 50 = 0 or vec_id > 699"), 10).toPandas()
    hits = total = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own.score, d[own.vec_id])
        hits, total = hits + len(set(want) & set(own.vec_id)), total + 10
    assert hits / total >= 0.9 and set(got.query_id) == set(range(0, 600, 50))
    same = got[got.query_id == 100].sort_values("rank")
    assert same.vec_id.tolist() == [0, *range(101, 110)]  # equal vectors: the smallest ids
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_over_shards_of_tight_clusters(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((30, 16)) * 3
    vectors = (centres[np.arange(1500) % 30] + 0.01 * draw.standard_normal((1500, 16))).round(6)
    rows = [(k, v.tolist(), "x", k) for k, v in enumerate(vectors)]
    rows += [(2000, [float("inf")] * 16, "x", 0), (2001, [1.0] * 5, "x", 0), (2002, [1.0, 2.0, 3.0, 4.0, 6.0], "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, ids string, shard int")
    monkeypatch.setattr(ann, "SHARD_ROWS", 256)
    monkeypatch.setattr(ann.build_index, "__defaults__", (256,))
    got = ann.nearest(df, df.filter("vec_id % 25 = 0 or vec_id > 1999"), 10, width=40).toPandas()
    hits = 0
    for q in range(0, 1500, 25):
        d = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), d))[:10]) & set(got[got.query_id == q].vec_id))
    assert hits / 600 >= 0.99
    assert got[got.query_id == 2001].vec_id.tolist() == [2002] and 2000 not in set(got.query_id)


def test_toxicity_learns_words_and_stems(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    rows, labels = [], []
    for k in range(900):
        bad = k % 3 == 0
        words = prose(k + 100, 60).split()
        if bad:
            words[10:10] = ["nasty", f"vile{k}"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    df = spark.createDataFrame([*rows, (None, "x"), (5000, None), (5001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(df, lab).collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held)
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in held]) > 0.95
    assert got[5000].score == got[5001].score == 0
    none = toxicity.score_documents(df, lab.limit(0))
    assert none.agg(F.max("score")).first()[0] == 0


def test_toxicity_windows_cover_every_word():
    lengths = np.array([0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 1000])
    text, first, size = toxicity.windows_of(lengths)
    begin = np.cumsum(lengths) - lengths
    for k, n in enumerate(lengths):
        seen = {i for a, s in zip(first[text == k], size[text == k], strict=True) for i in range(a - begin[k], a - begin[k] + s)}
        assert seen == set(range(n))


def test_lm_scores(docs, empty):
    got = lm_score.score_documents(docs)
    rows = {(r.doc_id): r for r in got.collect()}
    assert got.count() == docs.count()
    assert rows[5].n_tokens == 0 and rows[5].log_likelihood == 0 and rows[5].mean_log_likelihood is None
    assert rows[0].n_tokens == 80 and rows[0].log_likelihood < 0
    assert lm_score.score_documents(empty).count() == 0
    w = lm_score.start_weights()
    around = np.repeat(np.array([[1, 2, 3, lm_score.TOKENS]]), lm_score.TOKENS, axis=0)
    assert abs(np.exp(lm_score.log_probabilities(w, around, np.arange(lm_score.TOKENS))).sum() - 1) < 1e-4
    tokens = lm_score.tokenized(docs, lm_score.vocabulary(docs))
    before = lm_score.score_tokens(tokens, w).agg(F.sum("log_likelihood")).first()[0]
    after = lm_score.score_tokens(tokens, lm_score.fit(tokens)).agg(F.sum("log_likelihood")).first()[0]
    assert after > before


def test_lm_trains_every_position_once(spark, monkeypatch):
    df = spark.createDataFrame([(n, prose(n, n)) for n in range(1, 40)], "doc_id long, text string").repartition(2)
    tokens = lm_score.tokenized(df, lm_score.vocabulary(df))
    seen = []
    for nth in range(lm_score.ROUNDS):
        made = []  # one unit of learning per training target, so that the averages count them

        def count(w, seen, around, target):
            w["hidden_b"][0] += len(target)
            w["hidden_b"][1] += (around == lm_score.TOKENS).sum()

        monkeypatch.setattr(lm_score, "step", count)
        monkeypatch.setattr(lm_score, "_pack", lambda w: np.pad(w["hidden_b"][:2], (0, lm_score.CHUNK - 2)).astype(np.float64))
        monkeypatch.setattr(lm_score, "_unpack", lambda flat, like: made.extend(flat[:2]))
        lm_score.train_round(tokens.coalesce(1), lm_score.start_weights(), nth)
        seen.append(made)
    targets, beyond = np.array(seen).sum(axis=0)
    assert targets == sum(range(1, 40))
    assert beyond == sum(2 * min(n, 2) + 2 * min(n, 1) for n in range(1, 40))
    ids, lengths = np.arange(40), np.array([1, 0, 7, 32])
    assert np.array_equal(lm_score.rounds_of(ids, lengths)[1:8], lm_score.rounds_of(ids[1:8], np.array([7])))
    share = [(lm_score.rounds_of(np.arange(100), np.full(10, 10)) == k).mean() for k in range(lm_score.ROUNDS)]
    assert min(share) > 0.3


def test_lm_copies_are_few_and_weighted(spark, monkeypatch):
    # the copies that are sent grow with the words, not as input splits times vocabulary
    each = lambda words, weights, tasks: lm_score.copies_for(words, weights, tasks, 6)
    assert each(10**9, 10**6, 400) == 125 and each(10**9, 10**6, 40) == 40 and each(10**6, 10**6, 40) == 6 and each(10, 10**6, 2) == 2
    assert [lm_score.groups_for(n) for n in (0, 1, 16, 40, 10**6)] == [1, 1, 4, 6, lm_score.GROUPS]
    df = spark.createDataFrame([(n, prose(n, n)) for n in range(1, 40)], "doc_id long, text string")
    tokens = lm_score.tokenized(df.repartition(3), lm_score.vocabulary(df))
    sizes = tokens.select((F.length("ids") / 4).alias("n"), F.spark_partition_id().alias("task")).groupBy("task").agg(F.sum("n").alias("n"))
    sizes = [int(r.n) for r in sizes.collect()]
    tasks, part = [], lm_score.train_round

    def told(tokens, w, nth):
        tasks.append(tokens.rdd.getNumPartitions())
        return w

    monkeypatch.setattr(lm_score, "train_round", told)
    monkeypatch.setattr(lm_score, "copies_for", lambda *a: 1)
    lm_score.fit(tokens)
    lm_score.fit(tokens, words=sum(sizes))
    assert set(tasks[: lm_score.ROUNDS]) == {tokens.rdd.getNumPartitions()} and set(tasks[lm_score.ROUNDS :]) == {1}

    def count(w, seen, around, target):
        w["hidden_b"][0] = len(target)

    monkeypatch.setattr(lm_score, "step", count)
    monkeypatch.setattr(lm_score, "rounds_of", lambda ids, lengths: np.zeros(len(ids), np.int64))
    got = part(tokens, lm_score.start_weights(), 0)["hidden_b"][0]
    assert abs(got - sum(n * n for n in sizes) / sum(sizes)) < 1e-3


def test_lm_steps_on_all_rows_as_on_some():
    draw = np.random.default_rng(5)
    used = np.full(lm_score.OTHERS, 3)
    plain = lm_score.start_weights(used=used)
    fast = {k: v.copy() for k, v in plain.items()}
    seen = {k: np.full_like(v, lm_score.FIRST_SQUARES) for k, v in plain.items()}
    squares = {k: v.copy() for k, v in seen.items()}
    top = lm_score.TOKENS + 1 + 3 * lm_score.OTHERS  # more tokens than 16 bits hold are sorted as well
    for n in (60_000, 50):  # nearly every row, and few
        around, target = draw.integers(0, top, (n, 2 * lm_score.SIDE)), draw.integers(0, lm_score.TOKENS, n)
        g = lm_score.gradients(plain, around, target)
        flat, rows = around.ravel(), np.unique(around)
        order = np.argsort(flat, kind="stable")
        g["vector"] = rows, np.add.reduceat(g["vector"][order], np.searchsorted(flat[order], rows))
        for k, v in g.items():
            at, v = v if isinstance(v, tuple) else (slice(None), v)
            squares[k][at] += v**2
            plain[k][at] -= lm_score.RATE * v / np.sqrt(squares[k][at])
        lm_score.step(fast, seen, around, target)
        assert all(np.array_equal(plain[k], fast[k]) and np.array_equal(squares[k], seen[k]) for k in plain)
    values = draw.integers(0, 1 << 20, 10_000)
    assert np.array_equal(lm_score._sorted(values), np.argsort(values, kind="stable"))


def test_lm_counts_leave_a_task_together(monkeypatch):
    frame = pd.DataFrame({"text": [prose(n, 50) for n in range(40)] + [None, ""]})
    monkeypatch.setattr(lm_score, "CHARS", 300, raising=False)
    out = list(lm_score._count(iter([frame, frame])))
    assert len(out) == 1  # before, one for each frame and block of text
    words = pd.Series([w for t in frame["text"][:40] for w in t.lower().split()])
    assert sorted(out[0]["n"]) == sorted(2 * words.value_counts()) and out[0]["word"].is_unique
    monkeypatch.setattr(lm_score, "COUNTED", 500)
    several = list(lm_score._count(iter([frame, frame])))
    assert len(several) > 1 and pd.concat(several).groupby("word")["n"].sum().equals(out[0].set_index("word")["n"].sort_index())
    assert list(lm_score._count(iter([]))) == []


def test_lm_sums_of_groups_are_those_of_numpy():
    draw = np.random.default_rng(8)
    sizes = np.concatenate([np.arange(1, 40), np.ones(50, int), [300, 2000], draw.integers(1, 12, 200)])
    for size in (sizes, np.array([1, 1]), np.array([3]), np.array([50]), np.full(4, lm_score.SHORT)):
        values = draw.standard_normal((size.sum(), lm_score.VECTOR)).astype(np.float32)
        order, first = draw.permutation(len(values)), np.cumsum(size) - size
        assert np.array_equal(lm_score._added(values, order, first), np.add.reduceat(values[order], first))


def test_lm_scores_in_blocks_and_with_large_logits(monkeypatch):
    draw = np.random.default_rng(4)
    w = lm_score.start_weights(used=np.full(lm_score.OTHERS, 3))
    ids, lengths = draw.integers(0, lm_score.TOKENS + 1 + 3 * lm_score.OTHERS, 700), np.array([0, 1, 2, 400, 0, 297])
    ids[ids == lm_score.TOKENS] = 7
    around = lm_score.neighbours(ids, lengths)
    some = draw.permutation(700)[:100]
    assert np.array_equal(lm_score.neighbours(ids, lengths, some), around[some])
    monkeypatch.setattr(lm_score, "AT_ONCE", 64)  # the first block has common words only, the last one words in slots
    want = [plain_log_probability(w, a, t) for a, t in zip(around, ids, strict=True)]
    for most in (600, 0.01):  # beyond it, a row's greatest logit is taken off
        monkeypatch.setattr(lm_score, "LARGE", most)
        assert np.allclose(lm_score.log_probabilities(w, around, ids), want, atol=1e-6)
    monkeypatch.undo()
    w["cls"] *= 1e6  # e to such logits is no number of 64 bits
    assert np.isfinite(lm_score.log_probabilities(w, around, ids)).all()
    lm_score.step(w, {k: np.full_like(v, lm_score.FIRST_SQUARES) for k, v in w.items()}, around, ids)
    assert all(np.isfinite(v).all() for v in w.values())


def plain_log_probability(w, around, target):
    """One token, level by level, in plain numbers."""
    x = np.concatenate([w["vector"][t] for t in around]).astype(np.float64)
    h = np.tanh(x @ w["hidden"].astype(np.float64) + w["hidden_b"])
    head, slot = (target, 0) if target < lm_score.TOKENS else (
        lm_score.VOCABULARY + (target - lm_score.TOKENS - 1) % lm_score.OTHERS, (target - lm_score.TOKENS - 1) // lm_score.OTHERS + 1
    )
    path = [("cls", 0, head // 256), ("mid", head // 256, head // 16 % 16), ("leaf", head // 16, head % 16)]
    if "slot" in w and head >= lm_score.VOCABULARY:
        path.append(("slot", head - lm_score.VOCABULARY, slot))
    total = 0.0
    for name, group, goal in path:
        z = h @ w[name][group].astype(np.float64) + w[f"{name}_b"][group]
        total += z[goal] - np.log(np.exp(z).sum())
    return total


def test_lm_scores_one_document_as_plain_numbers_do():
    draw = np.random.default_rng(3)
    w = lm_score.start_weights(used=np.arange(lm_score.OTHERS) % 4)
    tokens = np.concatenate([draw.integers(0, lm_score.TOKENS, 40), lm_score.TOKENS + 1 + np.array([1, 2, 3, 6, 7, 256 + 2, 256 + 7])])
    draw.shuffle(tokens)
    around = lm_score.neighbours(tokens, np.array([len(tokens)]))
    padded = [lm_score.TOKENS] * 2 + tokens.tolist() + [lm_score.TOKENS] * 2
    want = [plain_log_probability(w, [*padded[i : i + 2], *padded[i + 3 : i + 5]], t) for i, t in enumerate(tokens.tolist())]
    assert np.allclose(lm_score.log_probabilities(w, around, tokens), want, atol=1e-5)
    # gradients beside differences of the plain score
    g = lm_score.gradients(w, around, tokens)
    for name, at in (("hidden", (5, 3)), ("hidden_b", (7,)), ("cls", (0, 4, 2)), ("mid", (int(tokens.min()) // 256, 3, 1)), ("leaf", (int(tokens.min()) // 16, 2, 5))):
        made = np.zeros_like(w[name], np.float64)
        if isinstance(g[name], tuple):
            made[g[name][0]] = g[name][1]
        else:
            made = g[name]
        sums = []
        for move in (1e-2, -1e-2):
            moved = {k: v.astype(np.float64) for k, v in w.items()}
            moved[name][at] += move
            sums.append(-sum(plain_log_probability(moved, [*padded[i : i + 2], *padded[i + 3 : i + 5]], t) for i, t in enumerate(tokens.tolist())))
        assert abs((sums[0] - sums[1]) / 2e-2 - made[at]) < 2e-3 * max(1, abs(made[at]))


def test_lm_scores_words_not_buckets(spark, monkeypatch):
    from shelfwise.llm.words import runs_of

    names = [f"w{k}" for k in range(6000)]
    buckets = runs_of([" ".join(names)]).hash % np.uint64(lm_score.OTHERS)
    one, two = np.flatnonzero(buckets == buckets[-1])[-2:]  # both rare, in one bucket, 1 and 3 times alone
    rows = [" ".join(names[:5000] * 4), *names[5000:], names[two], names[two]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.log_likelihood for r in lm_score.score_documents(df).collect()}
    assert abs(got[len(rows) - 1] - got[rows.index(names[one])] - np.log(3)) < 1e-6
    assert got[len(rows) - 1] == got[len(rows) - 2]
    # above the count every word is a token, and all probabilities sum to 1
    monkeypatch.setattr(lm_score, "MIN_COUNT", 3)
    words = lm_score.vocabulary(df)
    ids = lm_score.own_tokens(words)
    assert len(words) == 5001 == len(set(ids.tolist())) and lm_score.TOKENS not in ids
    w = lm_score.start_weights(used=lm_score.slots_used(words))
    every = np.concatenate([ids, np.arange(lm_score.VOCABULARY, lm_score.TOKENS)])
    around = np.repeat(np.array([[1, lm_score.TOKENS, ids[-1], 3]]), len(every), axis=0)
    assert abs(np.exp(lm_score.log_probabilities(w, around, every)).sum() - 1) < 1e-4
    before = lm_score.log_probabilities(w, around[:512], every[-512:]).mean()
    seen = {k: np.full_like(v, 1e-6) for k, v in w.items()}
    for _ in range(30):
        lm_score.step(w, seen, around[:512], every[-512:])
    assert lm_score.log_probabilities(w, around[:512], every[-512:]).mean() > before


def test_language(spark, docs, empty):
    texts = {"en": "the house of the king and that which was there", "de": "der weg und das haus nicht für die straße"}
    rows = [(k, f"{texts['en' if k % 2 else 'de']} {k}", "en" if k % 2 else "de") for k in range(200)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 ?", "de"), (902, "that house", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[k].lang_pred == rows[k][2] for k in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en"
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.select("text").collect())


def test_language_stage_keeps_texts_when_nothing_is_learned(spark, docs):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0)
    one = spark.createDataFrame([(held, "the house of the king", "en")], "doc_id long, text string, lang string")
    assert langid.keep_identified(one).count() == 1
    kept = langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == docs.columns
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.select("text").collect())


def test_secrets(spark, docs, empty):
    model = secrets.train(secrets.labelled_findings(spark, 2000))
    found = {r.value: r for r in secrets.scan(docs, model).collect()}
    assert found["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"].secret and found["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"].start == 11
    assert not found["ann12@mail3.example.com"].secret and not found["4785380592391139"].secret
    for r in docs.collect():
        assert {m.start() for m in re.finditer(secrets.CANDIDATE, r.text or "")} == {
            f.start for f in secrets.candidates(docs.filter(F.col("doc_id").eqNullSafe(r.doc_id)).limit(1)).collect()
        } if r.doc_id in (18, 19) else True
    clean = secrets.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.filter("doc_id = 18").first().text == 'x token = "[SECRET]" y'
    assert secrets.redact(empty, model).count() == secrets.scan(empty, model).count() == 0
    plan = secrets.redact(docs, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets_of_any_form_behind_a_name(spark):
    planted = [
        ('password = "', "Tr0ub4dor&3", '"'), ("password: ", "hunter2", ""), ('pwd = "', "P@ssw0rd!2024", '"'),
        ('password = "', "aB3$kL9#mN2!pQ7w", '"'), ('secret = "', "correct-horse-battery-staple", '"'),
        ("DB_PASSWORD=", "aB3$kL9#mN2!pQ7w", ""), ("see postgres://admin:", "p@S$w0rd9", "@db.example.com:5432/main"),
        ('{"token": "', "x7!kQ9#zz", '"}'),
    ]
    harmless = ["the password: please ask for it", "password = ${DB_PASSWORD}", "see https://www.example.com/page:80/index", "monkey: bananas are here"]
    rows = [f"hunter2 said {a}{v}{b} and more" for a, v, b in planted] + harmless
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = secrets.train(secrets.labelled_findings(spark))
    found = {(r.doc_id, r.start, r.value) for r in secrets.scan(df, model).filter("secret").collect()}
    expected = {(k, rows[k].rindex(v), v) for k, (_, v, _) in enumerate(planted)}
    assert found == expected
    clean = {r.doc_id: r.text for r in secrets.redact(df, model).collect()}
    assert clean == dict(enumerate([f"hunter2 said {a}[SECRET]{b} and more" for a, _, b in planted] + harmless))


def test_packing(docs, empty):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, vocabulary).toPandas()
    tokenizer = Tokenizer.from_file(vocabulary)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            key = (r.doc_id, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    have: dict = {}
    for p in got.itertuples():
        key = (None if pd.isna(p.doc_id) else int(p.doc_id), p.start, p.length, p.ids_crc32, p.doc_tokens)
        have[key] = have.get(key, 0) + 1
    assert have == want
    for _, window in got.groupby("sequence_id"):
        window = window.sort_values("offset")
        ends = window.offset + window.length
        assert window.offset.tolist() == [0, *ends.tolist()[:-1]] and ends.max() <= 2048
    assert packing.pack_documents(empty, vocabulary).count() == 0


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_takes_the_tightest_window(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offset = packing.best_fit(np.array(lengths, np.int64), 64)
    used: list[int] = []
    for k, n in enumerate(lengths):
        fits = [64 - u for u in used if 64 - u >= n]
        if fits:
            assert 64 - used[where[k]] == min(fits) and offset[k] == used[where[k]]
        else:
            assert where[k] == len(used) and offset[k] == 0
            used.append(0)
        used[where[k]] += n


def plain_line_dedup(rows, size=3):
    seen, out = {}, {}
    for doc_id, text in sorted({r for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0])):
        lines = text.split("\n")
        keys = [x.strip(" \t\r") for x in lines]
        gone = set()
        for a in range(max(1, len(lines) - size + 1)):
            window = tuple(keys[a : a + size])
            if any(window):
                if window in seen:
                    gone |= set(range(a, min(a + size, len(lines))))
                seen.setdefault(window, (doc_id, a))
        out[(doc_id, text)] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_line_dedup(docs, empty):
    want = plain_line_dedup([(r.doc_id, r.text) for r in docs.collect()])
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in line_dedup.drop_repeated_lines(docs).filter("doc_id is not null").collect():
        cut, gone = want.get((r.doc_id, texts[r.doc_id]), (texts[r.doc_id], 0))
        assert (r.text, r.removed_lines) == (cut, gone)
    assert line_dedup.drop_repeated_lines(docs).count() == docs.count()
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_dedup_of_blanks_at_line_ends_and_clashing_names(spark):
    lines = [f"{prose(k, 6)}" for k in range(30, 34)]
    texts = ["\n".join(lines), "top\n" + "\r\n".join(lines) + "\r", "x\n" + "\n".join(f"\t{x} " for x in lines) + "\nend"]
    names = "doc_id long, text string, g_id int, g_key int, g_at int, own_text int, doc int, parts int, lines string, key int, at int"
    df = spark.createDataFrame([(k, t, 1, 2, 3, 4, 5, 6, "old", 7, 8) for k, t in enumerate(texts)], names).repartition(2)
    got = {r.doc_id: (r.text, r.removed_lines, r.g_at) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {0: (texts[0], 0, 3), 1: ("top", 4, 3), 2: ("x\nend", 4, 3)}


@pytest.fixture(scope="module")
def ranks():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return bpe.ranks(path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})


@given(st.lists(st.text(alphabet="abeéñthnig 12漢字😀\n'sr²", max_size=300), max_size=5))
@settings(max_examples=60, deadline=None)
def test_bpe_is_as_tiktoken(ranks, texts):
    table, library = ranks
    for text, ids in zip(texts, table.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert table.decode(ids) == text.encode()


def test_bpe_long_word_and_queries(docs, ranks):
    table, library = ranks
    word = "".join(np.random.default_rng(1).choice(list("abcde"), 20_000))
    assert table.encode([word])[0].tolist() == library.encode_ordinary(word)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = docs.select("text", bpe.round_trip(F.col("text"), path).alias("r"), bpe.decode(bpe.encode(F.col("text"), path), path).alias("back"))
    for r in both.collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.r.n_tokens == len(ids) and bytes(r.back) == (r.text or "").encode()
        assert r.r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@given(st.lists(st.text(alphabet="aZé1² \t\n'.stremvld漢Ⅷ‍_", max_size=12), max_size=4))
@settings(max_examples=300, deadline=None)
def test_words_are_split_as_by_the_pattern(texts):
    codes, starts = code_points(texts)
    joined = "".join(texts)
    begins = split_words(codes, starts).tolist()
    got = [joined[a:b] for a, b in zip(begins, [*begins[1:], len(joined)][: len(begins)], strict=True)]
    assert got == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]


def test_long_words_that_swap_characters_differ():
    from shelfwise.llm.words import WordTable, listed, runs_of

    for apart, at in ((256, 10), (64, 3), (512, 0)):
        first, second = (f"{'a' * k}b{'a' * (699 - k)}" for k in (at, at + apart))
        assert len(set(runs_of([first, second]).hash.tolist())) == 2
        ids, starts = WordTable(lambda words: listed([[ord(c) for c in w] for w in words])).encode([first, second])
        assert [("".join(map(chr, ids[a:b]))) for a, b in zip(starts[:-1], starts[1:], strict=True)] == [first, second]


def test_word_ids_stay_right_over_generations(monkeypatch):
    from shelfwise.llm import words

    monkeypatch.setattr(words, "CACHED_WORDS", 60)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = packing.TextIds(path), Tokenizer.from_file(path)
    for k in range(12):
        texts = [prose(k % 5, 30), "it's  we'll \n\tdon't x1 \u00e9t\u00e9", f" a{k}b ...!? {k}\r\n", " ", "", "a" * 700, "caf\u00e9 na\u00efve \u6f22"]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[top(a)] = top(b)
    groups: dict = {}
    for k, (doc_id, _) in enumerate(rows):
        groups.setdefault(top(k), []).append(doc_id)
    least = {k: min((x for x in g if x is not None), default=None) for k, g in groups.items()}
    return [(rows[k][0], least[top(k)], links[k]) for k in range(len(rows))]


def test_similar_groups(spark, docs, empty, monkeypatch):
    base = prose(50, 120).split()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(70):  # a group larger than a block, each text another
        rows.append((1000 + k, " ".join([*base[:k], f"w{k}", *base[k + 1 :]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = ngram_join.similar_groups(df)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=key) == sorted(plain_groups(rows), key=key)
    assert ngram_join.similar_groups(empty).count() == 0
    bands, height = ngram_join.choose_bands(0.8, 0.999, 160)
    assert 1 - (1 - 0.8**height) ** bands >= 0.999 and bands * height <= 160


def test_similar_stage_alone_keeps_one_row_of_repeats(spark):
    base, other = prose(70, 60), prose(71, 60)
    near = " ".join([*base.split()[:59], "changed"])
    rows = [(1, base), (1, base), (2, near), (None, other), (None, other), (3, other), (4, ""), (4, ""), (5, None)]
    clash = "doc_id long, text string, gone_id int, gone_key int, again_id int, own_id int, doc int, cls int"
    df = spark.createDataFrame([(*r, 0, 1, 2, 3, 4, 5) for r in rows], clash).repartition(3)
    left = ngram_join.keep_one_of_similar(df)
    assert left.columns == df.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([(1, base), (3, other), (4, ""), (4, ""), (5, None)], key=key)


def test_secret_stage_with_columns_named_like_its_own(spark):
    model = secrets.train(secrets.labelled_findings(spark, 2000))
    names = "doc_id long, text string, s_id int, s_key int, s_values int, own_text string, key string, value string, start int, doc int"
    text = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'
    df = spark.createDataFrame([(k, t, 1, 2, 3, "a", "b", "c", 4, 5) for k, t in ((1, text), (None, text), (2, "plain"), (3, None))], names)
    got = secrets.redact(df, model)
    assert got.columns == df.columns
    assert sorted(str(r.text) for r in got.collect()) == ["None", "plain", 'x token = "[SECRET]" y', 'x token = "[SECRET]" y']
    assert {(r.s_id, r.own_text, r.doc) for r in got.collect()} == {(1, "a", 5)}


def test_pipeline(spark, docs, tmp_path):
    docs.drop("n", "kept").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    groups: dict = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    rows = [r for r, (own, least, _) in zip(rows, plain_groups(rows), strict=True) if own == least]
    masked = [(k, t.replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[SECRET]")) for k, t in rows]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in masked}
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    have = got.groupby(got.doc_id.astype("Int64").astype(object).where(got.doc_id.notna(), None), dropna=False)["length"].sum()
    assert {None if pd.isna(k) else int(k): n for k, n in have.items()} == want
