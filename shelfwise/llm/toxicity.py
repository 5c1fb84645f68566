"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Input of a word: its own vector (words seen often enough in training) plus the mean vector of its
character 3- and 5-grams. The network reads windows of WINDOW words that overlap and cover every
word of a text; attention pools the states of a window; a text's score is its highest window's.

Training in numpy, on a bounded sample of labelled rows: at most TRAIN_DOCS documents per label and
TRAIN_WINDOWS windows per label, both by hash order. A window takes its document's label; after the
first epochs, windows of toxic documents that look clean are left out, as a toxic document also has clean passages. One in CALIBRATE of the sampled documents is
kept out of the windows; on their whole texts the logit is found that best splits the labels, and
scores are shifted so that it becomes 0.5.

Text without words (NULL and empty too) scores 0. Labels: the highest of repeated ones; NULL labels
and ids are not learned from. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import blocks, bounded_batches, held_out
from shelfwise.llm.words import Runs, runs_of
from shelfwise.sources.scratch import stage

WINDOW, STRIDE = 96, 72
TRAIN_DOCS = 2000
TRAIN_WINDOWS = 4000
VECTOR, STATE = 8, 8
GRAMS = 1 << 14
MIN_COUNT = 25
EPOCHS, BATCH, RATE = 4, 64, 0.05
TRUST_AFTER = 2
CALIBRATE = 5
AT_ONCE = 2048


def windows_of(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of so many words: text, first word (within all words), number of words."""
    count = np.where(per_text == 0, 0, 1 + np.maximum(0, -(-(per_text - WINDOW) // STRIDE)))
    text = np.repeat(np.arange(len(per_text)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(per_text) - per_text
    return text, begin[text] + nth * STRIDE, np.minimum(WINDOW, per_text[text] - nth * STRIDE)


def char_grams(runs: Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 3- and 5-grams of the given words, with a mark at both ends, and where each
    word's grams start."""
    length = runs.length[which]
    wide = length + 2
    begin = np.cumsum(wide) - wide
    word = np.repeat(np.arange(len(which)), wide)
    place = np.arange(len(word)) - begin[word]
    codes = runs.codes[np.minimum(runs.first[which][word] + np.maximum(place - 1, 0), len(runs.codes) - 1)].astype(np.uint32)
    codes[place == 0], codes[place == wide[word] - 1] = 1, 2
    count = length + np.maximum(length - 2, 0)
    start = np.cumsum(count) - count
    out = np.empty(count.sum(), np.int64)
    for size, offset in ((3, np.zeros(len(which), np.int64)), (5, length)):
        m = len(codes) - size + 1
        at = np.flatnonzero(place[:max(m, 0)] + size <= wide[word[:max(m, 0)]])
        mixed = np.full(len(at), size, np.uint32)
        for k in range(size):
            mixed = (mixed ^ codes[at + k]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
        out[start[word[at]] + offset[word[at]] + place[at]] = (mixed >> np.uint32(4)) % np.uint32(GRAMS)
    return out, start


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1


class Network:
    """The weights, and the passes over windows of word numbers (windows, WINDOW), -1 where short."""

    def __init__(self, words: int, seed: int = 5, dtype=np.float32):
        draw = np.random.default_rng(seed)

        def some(*shape: int) -> np.ndarray:
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)

        self.w = {
            "word": (0.1 * draw.standard_normal((words + 1, VECTOR))).astype(dtype),
            "char": (0.1 * draw.standard_normal((GRAMS, VECTOR))).astype(dtype),
            "pool": some(2 * STATE, 2 * STATE), "pool_b": np.zeros(2 * STATE, dtype), "pool_v": some(2 * STATE),
            "out": some(2 * STATE), "out_b": np.zeros(1, dtype),
        }
        for way in "fb":
            self.w |= {f"in_{way}": some(VECTOR, 3 * STATE), f"in_b_{way}": np.zeros(3 * STATE, dtype), f"rec_{way}": some(STATE, 3 * STATE)}

    def inputs(self, own: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Word inputs: own vector plus the mean of the character grams' vectors."""
        count = np.diff(np.append(starts, len(grams)))[:, None]
        return self.w["word"][own] + np.add.reduceat(self.w["char"][grams], starts) / count.astype(self.w["char"].dtype)

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of the windows over inputs x; with keep, what the backward pass needs."""
        w, (n, steps) = self.w, index.shape
        mask = (index >= 0).astype(x.dtype)
        states = np.empty((n, steps, 2 * STATE), x.dtype)
        saved: dict = {"mask": mask, "states": states, "index": index, "x": x}
        for way, order, part in (("f", range(steps), slice(0, STATE)), ("b", range(steps - 1, -1, -1), slice(STATE, None))):
            ready = np.concatenate([x @ w[f"in_{way}"] + w[f"in_b_{way}"], np.zeros((1, 3 * STATE), x.dtype)])
            h = np.zeros((n, STATE), x.dtype)
            trace = []
            for t in order:
                a, b = ready[index[:, t]], h @ w[f"rec_{way}"]
                gate = _sigmoid(a[:, : 2 * STATE] + b[:, : 2 * STATE])
                z, r, c = gate[:, :STATE], gate[:, STATE:], b[:, 2 * STATE :]
                new = _tanh(a[:, 2 * STATE :] + r * c)
                if keep:
                    trace.append((t, h, z, r, c, new))
                h = (new + z * (h - new)) * mask[:, t, None]
                states[:, t, part] = h
            saved[way] = trace
        mixed = _tanh(states @ w["pool"] + w["pool_b"])
        weight = mixed @ w["pool_v"]
        weight = np.where(mask > 0, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        saved |= {"mixed": mixed, "weight": weight, "pooled": pooled}
        return pooled @ w["out"] + w["out_b"][0], saved

    def backward(self, saved: dict, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for d loss / d logit of each window; "x" has those of the inputs."""
        w, x, index, mask, states = self.w, saved["x"], saved["index"], saved["mask"], saved["states"]
        grad = {k: np.zeros_like(v) for k, v in w.items() if k not in ("word", "char")}
        grad["out"], grad["out_b"] = saved["pooled"].T @ error, np.array([error.sum()], x.dtype)
        pooled = error[:, None] * w["out"]
        weight, mixed = saved["weight"], saved["mixed"]
        d_weight = (states * pooled[:, None, :]).sum(axis=2)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        d_states = weight[:, :, None] * pooled[:, None, :]
        grad["pool_v"] = np.einsum("ntk,nt->k", mixed, d_weight)
        d_mixed = d_weight[:, :, None] * w["pool_v"] * (1 - mixed**2)
        grad["pool"], grad["pool_b"] = np.einsum("nti,ntj->ij", states, d_mixed), d_mixed.sum(axis=(0, 1))
        d_states = d_states + d_mixed @ w["pool"].T
        d_x = np.zeros((len(x) + 1, VECTOR), x.dtype)
        for way, part in (("f", slice(0, STATE)), ("b", slice(STATE, None))):
            rec, carry = w[f"rec_{way}"], np.zeros((len(index), STATE), x.dtype)
            d_ready = np.zeros((len(x) + 1, 3 * STATE), x.dtype)
            for t, h, z, r, c, new in reversed(saved[way]):
                d_h = (d_states[:, t, part] + carry) * mask[:, t, None]
                d_new = d_h * (1 - z) * (1 - new**2)
                d_z = d_h * (h - new) * z * (1 - z)
                d_r = d_new * c * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new], axis=1)
                d_b = np.concatenate([d_z, d_r, d_new * r], axis=1)
                grad[f"rec_{way}"] += h.T @ d_b
                carry = d_h * z + d_b @ rec.T
                np.add.at(d_ready, index[:, t], d_a)
            grad[f"in_b_{way}"] = d_ready[:-1].sum(axis=0)
            grad[f"in_{way}"] = x.T @ d_ready[:-1]
            d_x[:-1] += d_ready[:-1] @ w[f"in_{way}"].T
        grad["x"] = d_x[:-1]
        return grad


class Model:
    """The network with its list of known words."""

    def __init__(self, known: np.ndarray, network: Network):
        self.known, self.network, self.shift = known, network, 0.0

    @classmethod
    def restored(cls, known: np.ndarray, weights: dict, shift: float) -> Model:
        network = Network.__new__(Network)
        network.w = weights
        model = cls(known, network)
        model.shift = shift
        return model

    def own(self, hashed: np.ndarray) -> np.ndarray:
        """Number of each word's own vector; 0 for words that are not known."""
        if not len(self.known):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashed), len(self.known) - 1)
        return np.where(self.known[at] == hashed, at + 1, 0)

    def score(self, texts: list[str]) -> np.ndarray:
        """The highest window of each text, 0 to 1; 0 without words."""
        out = np.zeros(len(texts))
        runs = runs_of(texts)
        if not len(runs.hash):
            return out
        which, words = pd.factorize(runs.hash)
        sample = np.zeros(len(words), np.int64)
        sample[which[::-1]] = np.arange(len(which))[::-1]
        x = self.network.inputs(self.own(words), *char_grams(runs, sample))
        text, first, length = windows_of(runs.per_text)
        logits = np.empty(len(text), np.float64)
        for a in range(0, len(text), AT_ONCE):
            index = _index(which, first[a : a + AT_ONCE], length[a : a + AT_ONCE])
            logits[a : a + AT_ONCE] = self.network.forward(x, index)[0]
        begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        out[text[begin]] = _sigmoid(np.clip(np.maximum.reduceat(logits, begin) - self.shift, -50, 50))
        return out


def _index(which: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    place = np.arange(WINDOW)
    index = which[np.minimum(first[:, None] + place, len(which) - 1)]
    return np.where(place < length[:, None], index, -1)


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model | None:
    """Train on windows (texts of at most WINDOW words) and their labels."""
    runs = runs_of(texts)
    some = runs.per_text > 0
    if not len(texts) or labels[some].min(initial=1) == labels[some].max(initial=0):
        return None
    words, which, count = np.unique(runs.hash, return_inverse=True, return_counts=True)
    sample = np.zeros(len(words), np.int64)
    sample[which] = np.arange(len(which))
    known = words[count >= MIN_COUNT]
    model = Model(known, Network(len(known)))
    net, own = model.network, model.own(words)
    grams, starts = char_grams(runs, sample)
    per_word = np.diff(np.append(starts, len(grams)))
    begin = np.cumsum(runs.per_text) - runs.per_text
    rows = np.flatnonzero(some)
    draw = np.random.default_rng(seed)
    seen = {k: np.full_like(v, 1e-8) for k, v in net.w.items()}
    for epoch in range(epochs):
        if epoch >= TRUST_AFTER:
            looks = np.concatenate(
                [_logits(net, own, grams, starts, per_word, which, begin, runs.per_text, rows[a : a + AT_ONCE]) for a in range(0, len(rows), AT_ONCE)]
            )
            use = rows[(labels[rows] == 0) | (looks > 0)]
        else:
            use = rows
        # as many of either label, so that 0.5 splits them
        toxic, clean = use[labels[use] == 1], use[labels[use] == 0]
        if not len(toxic) or not len(clean):
            use, toxic, clean = rows, rows[labels[rows] == 1], rows[labels[rows] == 0]
        share = np.where(labels == 1, 0.5 / len(toxic), 0.5 / len(clean)) * len(use)
        order = draw.permutation(use)
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            index = _index(which, begin[batch], runs.per_text[batch])
            local, back = np.unique(index[index >= 0], return_inverse=True)
            at = np.full(index.shape, -1)
            at[index >= 0] = back
            part = _pick(grams, starts, per_word, local)
            x = net.inputs(own[local], *part)
            logit, saved = net.forward(x, at, keep=True)
            error = ((_sigmoid(logit) - labels[batch]) * share[batch] / len(batch)).astype(x.dtype)
            grad = net.backward(saved, error)
            d_x = grad.pop("x")
            for k, g in grad.items():
                seen[k] += g**2
                net.w[k] -= RATE * g / np.sqrt(seen[k])
            each = np.repeat(d_x / per_word[local][:, None], per_word[local], axis=0).astype(x.dtype)
            for k, at_rows, g in (("word", own[local], d_x), ("char", part[0], each)):
                rows_k, inverse = np.unique(at_rows, return_inverse=True)
                total = np.zeros((len(rows_k), VECTOR), x.dtype)
                np.add.at(total, inverse, g)
                seen[k][rows_k] += total**2
                net.w[k][rows_k] -= RATE * total / np.sqrt(seen[k][rows_k])
    return model


def _pick(grams: np.ndarray, starts: np.ndarray, per_word: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count = per_word[words]
    begin = np.cumsum(count) - count
    return grams[np.repeat(starts[words] - begin, count) + np.arange(count.sum())], begin


def _logits(net, own, grams, starts, per_word, which, begin, lengths, rows) -> np.ndarray:
    index = _index(which, begin[rows], lengths[rows])
    local, back = np.unique(index[index >= 0], return_inverse=True)
    at = np.full(index.shape, -1)
    at[index >= 0] = back
    return net.forward(net.inputs(own[local], *_pick(grams, starts, per_word, local)), at)[0]


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows' words as text, one row each."""
    for frame in frames:
        for part in blocks(frame, "text"):
            runs = runs_of([t if isinstance(t, str) else "" for t in part["text"]])
            text, first, length = windows_of(runs.per_text)
            last = first + length - 1
            ends = runs.first[last] + runs.length[last]
            cut = [
                runs.codes[a:b].astype("<u4").tobytes().decode("utf-32-le", "replace")
                for a, b in zip(runs.first[first].tolist(), ends.tolist(), strict=True)
            ]
            yield pd.DataFrame({"toxic": part["toxic"].to_numpy()[text], "words": cut})


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text, calibrate of at most TRAIN_DOCS labelled documents per label, none held out."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = [rows.filter(F.col("toxic") == y).orderBy(F.xxhash64("l_id")).limit(TRAIN_DOCS) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by TRAIN_DOCS
    joined = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("l_id"))
    return stage(joined.select("toxic", "text", (F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(CALIBRATE)) == 0).alias("calibrate")), "labelled")


def best_split(logits: np.ndarray, toxic: np.ndarray) -> float:
    """The logit with the highest mean of both labels' shares on their side, amid equal ones."""
    order = np.argsort(logits)
    value, y = logits[order], toxic[order]
    good = np.cumsum(1 - y) / max(1, (1 - y).sum()) + (y.sum() - np.cumsum(y)) / max(1, y.sum())
    at = np.flatnonzero(good >= good.max() - 1e-9)[0]
    return float((value[at] + value[min(at + 1, len(value) - 1)]) / 2)


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    texts = labelled_texts(docs, labels)
    cut = texts.filter(~F.col("calibrate")).select("toxic", "text").mapInPandas(_windows, "toxic int, words string")
    some = [cut.filter(F.col("toxic") == y).orderBy(F.xxhash64("words"), "words").limit(TRAIN_WINDOWS) for y in (0, 1)]
    frame = some[0].unionByName(some[1]).toPandas()
    model = fit(frame["words"].tolist(), frame["toxic"].to_numpy(np.float32))
    if model is None:
        return None
    own = score(docs.sparkSession, model, F.col("text")).alias("score")
    seen = texts.filter("calibrate").select("toxic", own).filter("score > 0").toPandas()
    if seen["toxic"].nunique() == 2:
        chance = seen["score"].to_numpy()
        model.shift = best_split(np.log(chance) - np.log1p(-np.minimum(chance, 1 - 1e-15)), seen["toxic"].to_numpy())
    return model


def score(spark: SparkSession, model: Model | None, text: Column) -> Column:
    # plain arrays: a broadcast value is not pickled with its class
    state = None if model is None else (model.known, model.network.w, model.shift)
    shared = spark.sparkContext.broadcast(state)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        model = None if shared.value is None else Model.restored(*shared.value)
        for part in blocks(texts.to_frame("text"), "text"):
            own = [t if isinstance(t, str) else "" for t in part["text"]]
            out.append(np.zeros(len(own)) if model is None else model.score(own))
        return pd.Series(np.concatenate(out))

    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    model = learn(docs, labels)
    made = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs.sparkSession, model, F.col("text")).alias("score")
    )
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
