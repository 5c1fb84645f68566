"""The learned scorers beside the same arithmetic written out in plain loops."""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pytest

from shelfwise.llm import langid, toxicity, words


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_logit(w, xs):
    """One window, word by word: both directions, attention over the words, one output."""
    state = toxicity.STATE
    sides = {}
    for way, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        h, sides[way] = np.zeros(state), {}
        for t in order:
            a, b = xs[t] @ w[f"in_{way}"] + w[f"in_b_{way}"], h @ w[f"rec_{way}"]
            z = np.array([sigmoid(v) for v in (a + b)[:state]])
            r = np.array([sigmoid(v) for v in (a + b)[state : 2 * state]])
            new = np.tanh(a[2 * state :] + r * b[2 * state :])
            h = (1 - z) * new + z * h
            sides[way][t] = h
    states = [np.concatenate([sides["f"][t], sides["b"][t]]) for t in range(len(xs))]
    looks = [math.exp(float(np.tanh(s @ w["pool"] + w["pool_b"]) @ w["pool_v"])) for s in states]
    pooled = sum(k * s for k, s in zip(looks, states, strict=True)) / sum(looks)
    return float(pooled @ w["out"] + w["out_b"][0])


@pytest.fixture(scope="module")
def network():
    return toxicity.Network(20, dtype=np.float64)


def test_toxicity_forward_pass(network):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((12, toxicity.VECTOR)) * 0.5
    index = np.full((3, 7), -1)
    for row, n in enumerate((7, 1, 4)):  # windows shorter than the block are filled up
        index[row, :n] = draw.integers(0, 12, n)
    logits, _ = network.forward(x, index)
    want = [plain_logit(network.w, [x[k] for k in row if k >= 0]) for row in index]
    assert np.allclose(logits, want, atol=1e-6)


def test_toxicity_gradients(network):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((6, toxicity.VECTOR)) * 0.5
    index = np.array([[0, 1, 2, 3], [4, 5, -1, -1], [1, 1, 0, -1]])
    error = np.array([0.7, -1.1, 0.4])
    grad = network.backward(network.forward(x, index, keep=True)[1], error)
    total = lambda: float(network.forward(x, index)[0] @ error)
    for name in grad:
        values = x if name == "x" else network.w[name]
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in values.shape)
            old, sums = values[at], []
            for move in (1e-5, -1e-5):
                values[at] = old + move
                sums.append(total())
            values[at] = old
            assert abs((sums[0] - sums[1]) / 2e-5 - grad[name][at]) < 1e-5, name


def test_toxicity_score_is_that_of_the_worst_window(network):
    model = toxicity.Model(np.zeros(0, np.uint64), network)
    words = [f"word{k % 37}" for k in range(3 * toxicity.WINDOW + 5)]
    long = " ".join(words)
    _, first, size = toxicity.windows_of(np.array([len(words)]))
    parts = [" ".join(words[a : a + n]) for a, n in zip(first, size, strict=True)]
    scores = model.score([long, *parts, "", "!!", long])
    assert abs(scores[0] - max(scores[1 : 1 + len(parts)])) < 1e-9
    assert scores[-3] == scores[-2] == 0 and scores[-1] == scores[0]


def test_language_is_that_of_plain_naive_bayes(spark):
    texts = {
        "en": "the house of the king and that which was there", "de": "der weg und das haus nicht für die straße",
        "fr": "le roi et la maison dans une rue où il était",
    }
    draw = np.random.default_rng(3)
    rows = []
    for k in range(160):
        lang = sorted(texts)[k % 3]
        rows.append((k, " ".join(draw.choice(texts[lang].split(), 8)), lang))
    rows += [rows[4], rows[4], (500, "the der le " * 3000, None), (501, "zzz", None), (502, None, "en"), (503, "7 8", "de"), (504, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts: dict = {}
    number: dict = {}
    grams = lambda t: [int(f) for row in langid.ngram_rows([t])[0] for f in row if f < langid.FEATURES]
    for doc_id, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5 and any(c.isalpha() for c in text):
            number[lang] = number.get(lang, 0) + 1
            own = counts.setdefault(lang, {})
            for g in grams(text):
                own[g] = own.get(g, 0) + 1
    langs = sorted(counts)
    for r in langid.identify(frame).collect():
        if not r.doc_id or next(t for k, t, _ in rows if k == r.doc_id) is None or r.doc_id in (503, 504):
            continue
        text = next(t for k, t, _ in rows if k == r.doc_id)
        logs = {}
        for lang in langs:
            seen = sum(counts[lang].values()) + langid.SMOOTHING * langid.FEATURES
            logs[lang] = math.log((number[lang] + 1) / (sum(number.values()) + len(langs)))
            logs[lang] += sum(math.log((counts[lang].get(g, 0) + langid.SMOOTHING) / seen) for g in grams(text))
        best = max(langs, key=lambda lang: logs[lang])
        assert r.lang_pred == best
        assert abs(r.score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-6
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame).collect()}
    assert got[502] == got[503] == got[504] == "und"


def test_runs_of_letters_and_digits():
    texts = ["", "Ab 1c", "x", " - ", "", "a" * 70 + "-b" * 3, "é漢 \ud800ß", "end "]
    found = words.runs_of(texts)
    plain = [["".join(g) for inside, g in itertools.groupby(t.lower(), str.isalnum) if inside] for t in texts]
    joined = "".join(t.lower() + " " for t in texts)
    assert [joined[a : a + n] for a, n in zip(found.first.tolist(), found.length.tolist(), strict=True)] == sum(plain, [])
    assert found.per_text.tolist() == list(map(len, plain))
    each = {word: words.runs_of([word]).hash[0] for own in plain for word in own}
    assert [each[word] for own in plain for word in own] == found.hash.tolist() and len(set(each.values())) == len(each)
    assert words.runs_of([]).per_text.tolist() == [] and words.runs_of([" ", ""]).per_text.tolist() == [0, 0]
