"""Clean and pack a corpus: language, exact copies, similar texts, secrets, packing.

Every stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and gives a
DataFrame; run() writes it as Parquet and reads it back for the next. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import exact_dedup, langid, ngram_join, packing, secrets
from shelfwise.llm.common import table
from shelfwise.sources.scratch import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Texts that are NULL, empty or without a letter go; where no
    language could be learned, only those go. Rows are judged one by one, so repeated rows stay or go
    together; ties between languages go to the first by name."""
    return langid.keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest, then of the smallest doc_id (NULL last). NULL
    and empty texts are one group; of rows equal in text and id one stays."""
    return exact_dedup.drop_exact_copies(docs)


def without_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts, the one of the smallest doc_id (NULL last). Of rows
    equal in text and id one stays; texts without words (NULL, empty) are no group and all stay."""
    return ngram_join.keep_one_of_similar(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets masked in the text; every document stays, repeated rows are masked alike. NULL and empty
    texts stay as they are; n_chars follows the new text."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows. NULL and empty texts are the closing id alone; repeated rows are packed
    once each; ties in length go by doc_id (NULL last), start and checksum. An empty table gives no
    rows, here as in every stage."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identified),
    ("exact_copies", without_copies),
    ("similar_texts", without_similar),
    ("secrets", without_secrets),
    ("packing", packed),
]

# No stage but the exact copies can be said in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
