"""Helpers that several operators of this package share."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only up to this many rows of a few numbers each.
BROADCAST_KEYS = 1_000_000

# Rows, and bytes, of an Arrow batch between Spark and Python.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

# Characters of text that numpy works on at once inside a task.
BLOCK_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be long: an Arrow batch holds BATCH_ROWS rows and about BATCH_BYTES bytes at most,
    so that a worker's memory stays bounded. A smaller bound that the session already has stays."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << (10 * " kmgt".index(unit or " ")) <= most:
            spark.conf.set(key, most)


def held_out(doc_id: Column) -> Column:
    """True for the rows kept out of training: crc32 of the id as text is a multiple of 5.
    A missing id counts as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a counted side, up to BROADCAST_KEYS rows."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    holder = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker"))
    return holder.__dict__.setdefault(name, {})


def blocks(frame: pd.DataFrame, text: str, chars: int = BLOCK_CHARS) -> Iterator[pd.DataFrame]:
    """Consecutive row ranges of about that many characters, one row at least."""
    if frame.empty:
        return
    ends = frame[text].fillna("").str.len().to_numpy().cumsum()
    first = 0
    while first < len(frame):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + chars, side="right")))
        yield frame.iloc[first:last]
        first = last


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters as one array of code points, and the start of each text in it. A lone
    surrogate counts as its own code point."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def letter_table() -> np.ndarray:
    """For each code point: is it a letter."""
    cache = worker_cache("letters")
    if "is" not in cache:
        cache["is"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return cache["is"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
