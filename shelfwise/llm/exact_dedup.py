"""Exact copies of texts, found with a two-pass Bloom filter.

Pass one counts the filter positions of all rows; positions hit at least twice form a filter of
possibly repeated hashes. It is at most MAX_BITS bits, whatever the input. Pass two tests every
row: rows that miss the filter are unique and go straight through, only the others shuffle. Above
what the filter can tell apart more unique rows shuffle too; the result stays exact.

Texts are equal when identical after deleting the characters x20 and x09 to x0D. NULL counts as
empty, so empty, blank and NULL texts are one group. The row with the most code points stays, then
the one with the smallest doc_id; a NULL id comes last. Of rows equal in text and id one stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import small
from shelfwise.sources.scratch import stage

BITS_PER_ROW = 16
MIN_BITS = 1 << 16
MAX_BITS = 1 << 31  # 256 MB, the largest broadcast
BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 64 hex digits."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (rows * BITS_PER_ROW).bit_length()))


def _positions(key: Column, bits: int) -> tuple[Column, Column]:
    hashed = F.xxhash64(key)
    mask = F.lit(bits - 1).cast("long")
    return hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 32).bitwiseAND(mask)


def repeat_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The Bloom filter of the hashes that may occur more than once, as bytes."""
    hits = keys.select(F.explode(F.array(*_positions(F.col(column), bits))).alias("bit"))
    twice = hits.groupBy("bit").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1")
    parts = (
        # bucket n holds the values 32768 * (n - 1) + 1 to 32768 * n, so bits count from 1 here
        twice.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))
        .toLocalIterator()
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for part in parts:
        first = (part["bucket"] - 1) * 4096
        out[first : first + 4096] = np.frombuffer(part["bitmap"], dtype=np.uint8)
    return out


def maybe_repeated(df: DataFrame, column: str, bits: int, table: np.ndarray) -> Column:
    """True where the key's two positions are in the filter."""
    shared = df.sparkSession.sparkContext.broadcast(table.tobytes())

    @F.pandas_udf("boolean")
    def test(one: pd.Series, two: pd.Series) -> pd.Series:
        known = np.frombuffer(shared.value, dtype=np.uint8)

        def hit(at: pd.Series) -> np.ndarray:
            at = at.to_numpy(dtype=np.int64)
            return (known[at // 8] >> (at % 8).astype(np.uint8)) & 1

        return pd.Series((hit(one) & hit(two)).astype(bool))

    return test(*_positions(F.col(column), bits))


def _digests(docs: DataFrame) -> DataFrame:
    """One slim row per document, written once."""
    return stage(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"),
            F.unhex(text_digest(F.col("text"))).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def _winners(repeated: DataFrame) -> DataFrame:
    """Per text: group size and the row that stays, for groups of two and more. Equal rows shrink
    first, so a large group is summed inside the tasks."""
    same = repeated.groupBy("sha", "n", "doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row").alias("row")
    )
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row", "rows")
    groups = same.groupBy("sha").agg(F.sum("rows").alias("group_size"), F.min(best).alias("best"))
    return stage(
        groups.filter("group_size > 1").select(
            "sha",
            "group_size",
            F.col("best.doc_id").alias("keep_id"),
            (-F.col("best.n")).alias("keep_n"),
            F.col("best.row").alias("keep_row"),
            F.col("best.rows").alias("keep_rows"),
        ),
        "winners",
    )


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, np.ndarray]:
    digests = _digests(docs)
    bits = filter_bits(digests.count())
    table = repeat_filter(digests, "sha", bits)
    marked = digests.withColumn("maybe", maybe_repeated(digests, "sha", bits, table))
    return marked, _winners(marked.filter("maybe")), bits, table


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    marked, winners, _, _ = _split(docs)
    alone = [
        F.col("doc_id"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    ]
    straight = marked.filter(~F.col("maybe")).select(*alone)
    joined = marked.filter("maybe").join(small(winners, winners.count()), "sha", "left")
    grouped = F.col("group_size").isNotNull()
    shuffled = joined.select(
        "doc_id",
        F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(grouped, F.col("row") == F.col("keep_row")).otherwise(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return straight.unionByName(shuffled)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Texts of rows that miss the filter are
    never shuffled; the others meet the winners on text, length and id, so a large group spreads."""
    _, winners, bits, table = _split(docs)
    names = docs.columns
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"),
        F.unhex(text_digest(F.col("text"))).alias("sha"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"),
    )
    own = own.withColumn("maybe", maybe_repeated(own, "sha", bits, table))
    won = small(winners.select("sha", "keep_id", "keep_n", "keep_rows", "group_size"), winners.count())
    groups = small(winners.select(F.col("sha").alias("sha_g")), winners.count())
    straight = own.filter(~F.col("maybe")).select("doc")
    rest = own.filter("maybe")
    unique = rest.join(groups, rest["sha"] == groups["sha_g"], "left_anti").select("doc")
    kept = rest.join(
        won.withColumnRenamed("sha", "sha_w"),
        (F.col("sha") == F.col("sha_w")) & (F.col("n") == F.col("keep_n")) & F.col("doc.doc_id").eqNullSafe(F.col("keep_id")),
    )
    single = kept.filter("keep_rows = 1").select("doc")
    several = kept.filter("keep_rows > 1").dropDuplicates(["sha"]).select("doc")
    return straight.unionByName(unique).unionByName(single).unionByName(several).select("doc.*")
