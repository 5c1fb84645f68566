"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from all training rows, summed by Spark; the log-probability matrix (languages x
features, at most MATRIX_BYTES) is broadcast. A batch of texts becomes one sparse matrix (feature
indices and row starts) and meets the log-probabilities in numpy.

Text is lower-cased, every non-letter is a space; features are the 1-, 2- and 3-grams of that. NULL
text, text without a letter, or no training row at all gives `und` with score 0. Ties go to the
language that sorts first. Any number of further columns is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import blocks, bounded_batches, code_points, held_out, letter_table

FEATURES = 1 << 15
MATRIX_BYTES = 64 << 20
SMOOTHING = 0.1
UNKNOWN = "und"


def ngram_rows(texts: list[str], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature indices, the start of each text's indices, and whether it has a
    letter. Grams that are blank or cross a text's end get the index `features`, which weighs 0."""
    codes, starts = code_points([f" {t.lower()} " for t in texts])
    letters = letter_table()[codes]
    own = np.where(letters, codes, 32).astype(np.uint32)
    n = len(own)
    has = np.add.reduceat(letters, starts[:-1]) > 0 if n else np.zeros(0, bool)
    out = np.full((3, n), features, dtype=np.int32)
    ends = starts[1:]
    one = own * np.uint32(0x9E3779B1)
    for size in (1, 2, 3):
        m = n - size + 1
        hashed = one[:m].copy()
        some = letters[:m].copy()
        if size > 1:
            hashed ^= (own[1 : m + 1] * np.uint32(0x85EBCA6B)) >> np.uint32(1)
            some |= letters[1 : m + 1]
        if size > 2:
            hashed ^= (own[2 : m + 2] * np.uint32(0xC2B2AE35)) >> np.uint32(2)
            some |= letters[2 : m + 2]
        hashed = (hashed ^ np.uint32(size)) * np.uint32(0x27D4EB2F)
        out[size - 1, :m] = np.where(some, (hashed >> np.uint32(10)) % np.uint32(features), features)
        for back in range(1, size):  # grams that start here reach into the next text
            out[size - 1, ends - back] = features
    return out, starts, has


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for frame in frames:
        for part in blocks(frame, "text"):
            for lang, same in part.groupby("lang", sort=False):
                index, _, has = ngram_rows(same["text"].tolist())
                total = counts.setdefault(lang, np.zeros(FEATURES + 1, dtype=np.int64))
                total += np.bincount(index.ravel(), minlength=FEATURES + 1)
                total[FEATURES] += int(has.sum()) - int((index == FEATURES).sum())
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "feature": at, "hits": total[at]})


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages x features + 2): the features, the zero
    weight of blank grams, and the log prior. Rows: text, lang. Many languages get fewer features,
    so that the matrix stays within MATRIX_BYTES."""
    usable = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string"))
    number = usable.agg(F.count_distinct("lang")).first()[0]
    features = FEATURES
    while features > 256 and number * features * 8 > MATRIX_BYTES:
        features //= 2
    counted = usable.mapInPandas(_count, "lang string, feature int, hits long")
    folded = F.when(F.col("feature") == FEATURES, features).otherwise(F.col("feature") % features)
    got = counted.groupBy("lang", folded.alias("feature")).agg(F.sum("hits").alias("hits")).toPandas()
    langs = sorted(got["lang"].unique())
    matrix = np.zeros((len(langs), features + 1))
    matrix[got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), got["feature"].to_numpy(int)] = got["hits"]
    docs, seen = matrix[:, features], matrix[:, :features] + SMOOTHING
    out = np.zeros((len(langs), features + 2))
    out[:, :features] = np.log(seen / seen.sum(axis=1, keepdims=True))
    out[:, features + 1] = np.log((docs + 1) / (docs + 1).sum())
    return langs, out


def score_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior for each text."""
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not langs or not texts:
        return names, best
    index, starts, has = ngram_rows([t or "" for t in texts], matrix.shape[1] - 2)
    total = np.repeat(matrix[:, -1][:, None], len(texts), axis=1)
    for i, weights in enumerate(matrix):
        for row in index:
            total[i] += np.add.reduceat(weights[row], starts[:-1])
    top = total.argmax(axis=0)
    post = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
    for k in np.flatnonzero(has):
        names[k] = langs[top[k]]
    return names, np.where(has, post, 0.0)


def prediction(spark: SparkSession, langs: list[str], matrix: np.ndarray, text: Column) -> Column:
    """A struct of lang_pred and score for a text column."""
    model = spark.sparkContext.broadcast((langs, matrix))

    @F.pandas_udf("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        known, weights = model.value
        names: list[str] = []
        scores = [np.zeros(0)]
        for part in blocks(text.to_frame("text"), "text"):
            some, score = score_texts([t if isinstance(t, str) else None for t in part["text"]], known, weights)
            names += some
            scores.append(score)
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": np.concatenate(scores)})

    return run(text)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Learn from text and lang of the rows that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    langs, matrix = learn(docs)
    found = prediction(docs.sparkSession, langs, matrix, F.col("text")).alias("found")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found)
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, all columns; the others (no letter, NULL) go. Where
    no language could be learned, every text with a letter stays."""
    bounded_batches(docs.sparkSession)
    langs, matrix = learn(docs)
    if not langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = prediction(docs.sparkSession, langs, matrix, F.col("text"))
    return docs.filter(found["lang_pred"] != UNKNOWN)
