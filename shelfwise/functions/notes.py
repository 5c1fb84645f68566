"""Merchandiser notes: label and markdown-risk score, as one plain column expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Note wording per label, and the score of each label.
DEAD_STOCK_WORDS = ["no movement", "overstocked", "clearance"]
AGING_WORDS = ["season ending", "full racks", "not selling"]
RISK_SCORES = {"dead_stock": "1.0", "aging": "0.6", "healthy": "0.1"}
DEFAULT_RISK = "0.1"


def risk_label(note: Column) -> Column:
    text = F.lower(note)
    return (
        F.when(text.rlike("|".join(DEAD_STOCK_WORDS)), F.lit("dead_stock"))
        .when(text.rlike("|".join(AGING_WORDS)), F.lit("aging"))
        .otherwise(F.lit("healthy"))
    )


def score_of_label(label: Column) -> Column:
    score = F.lit(DEFAULT_RISK).cast("decimal(2,1)")
    for name, value in RISK_SCORES.items():
        score = F.when(label == name, F.lit(value).cast("decimal(2,1)")).otherwise(score)
    return score


def risk_score(note: Column) -> Column:
    """Score of a note; no note scores as healthy."""
    return score_of_label(risk_label(F.coalesce(note, F.lit(""))))


@F.pandas_udf(T.StringType())
def classify_batch(notes: pd.Series) -> pd.Series:
    """The same rules as an Arrow-batched function: the slot for an external classifier."""
    text = notes.str.lower()
    label = pd.Series("healthy", index=notes.index)
    label[text.str.contains("|".join(AGING_WORDS), regex=True, na=False)] = "aging"
    label[text.str.contains("|".join(DEAD_STOCK_WORDS), regex=True, na=False)] = "dead_stock"
    return label
