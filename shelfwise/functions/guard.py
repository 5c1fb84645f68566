"""Prompt guards, personal data, and the outcome of a model call."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Phrases of runaway reads (as patterns), blocked keywords, markers.
ALL_DATA_PHRASES = [
    "all customers", "every account", "entire dataset", "read everything", "unfiltered", "no filter",
    r"select \*", "list all customers", "all rows", "entire table", "all data", "every record",
    "dump the table",
]
BLOCKED_KEYWORDS = [
    "SELECT *", "select all rows", "all data", "entire table", "dump the table", "every record",
    "read all rows", "all rows from", "select everything", "no where clause",
]
LIMIT_MARK = "REQUEST_LIMIT_EXCEEDED"
GUARD_MARK = "guardrail"
SERVED_MARK = '"choices"'

# "++" never gives characters back, and the sign is not among them: same matches, no retries
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
CARD = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
TAGS = [(EMAIL, "<EMAIL_ADDRESS>"), (CARD, "<CREDIT_CARD>"), (SSN, "[SSN_REDACTED]")]

GUARD_FUNCTION = "guard_block_all_data"


def blocks_all_data(prompt: Column) -> Column:
    """TRUE for a prompt that asks for unfiltered data."""
    return F.lower(prompt).rlike("|".join(ALL_DATA_PHRASES))


def register_guard(spark: SparkSession, name: str = GUARD_FUNCTION) -> None:
    """The same guard as a SQL function."""
    pattern = "|".join(ALL_DATA_PHRASES).replace("\\", "\\\\")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(prompt STRING) RETURNS BOOLEAN "
        f"RETURN lower(prompt) RLIKE '{pattern}'"
    )


def blocks_keywords(prompt: Column, keywords: list[str] | None = None) -> Column:
    """TRUE if any keyword occurs, case aside."""
    words = [w.lower() for w in (keywords or BLOCKED_KEYWORDS)]
    text = F.lower(prompt)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def _has_email(text: Column) -> Column:
    """The plain search for the sign spares most texts the pattern."""
    return text.contains("@") & text.rlike(EMAIL)


def has_pii(text: Column) -> Column:
    return _has_email(text) | text.rlike(CARD) | text.rlike(SSN)


def redact(text: Column) -> Column:
    """Whole text with every e-mail address, card and social security number replaced by its tag."""
    clean = text
    for pattern, tag in TAGS:
        replaced = F.regexp_replace(clean, pattern, tag)
        clean = F.when(clean.contains("@"), replaced).otherwise(clean) if pattern == EMAIL else replaced
    return clean


def call_outcome(response: Column) -> Column:
    """First matching mark wins."""
    return (
        F.when(response.contains(LIMIT_MARK), "threshold_block")
        .when(response.contains(GUARD_MARK), "guardrail_block")
        .when(response.contains(SERVED_MARK), "served")
        .otherwise("other")
    )
