"""Lines that repeat across a corpus, found as overlapping windows of consecutive lines.

Every three consecutive lines are a window, known by a hash of the three line hashes; a text with
fewer lines has one window, all its lines. The first occurrence of a window, by document and
position, stays; every later one covers its lines, and covered lines go. Overlapping windows merge
in the covered positions, so a passage of n lines goes as a whole.

Lines end at \\n. Documents are ordered by doc_id (NULL last), then by a hash of the text; rows equal
in both are one document and share its result. Windows of blank lines alone never count. NULL text
stays NULL with no lines; empty text has no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import small, text_key
from shelfwise.sources.scratch import stage

WINDOW = 3


BLANKS = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    """A line as it is compared: without spaces, tabs and carriage returns at its ends."""
    return F.trim(line, F.lit(BLANKS))


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, key, at, upto, hash for every window of every document; upto is its last line."""
    hashes = F.transform(lines_of(F.col("text")), lambda line: F.xxhash64(bare(line)))
    blank = F.transform(lines_of(F.col("text")), lambda line: bare(line) == "")
    rows = docs.filter("text <> ''").select("doc_id", text_key(F.col("text")).alias("key"), hashes.alias("h"), blank.alias("b"))
    count = F.greatest(F.size("h") - (size - 1), F.lit(1))
    made = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            i.alias("at"),
            (F.least(i + size, F.size("h")) - 1).alias("upto"),
            F.xxhash64(F.slice("h", i + 1, size)).alias("hash"),
            F.forall(F.slice("b", i + 1, size), lambda x: x).alias("blank"),
        ),
    )
    every = rows.select("doc_id", "key", F.explode(made).alias("w")).select("doc_id", "key", "w.*")
    return every.filter(~F.col("blank")).select("doc_id", "key", "at", "upto", "hash")


def covered_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, key, at: the lines that go. Occurrences are counted inside the tasks before the
    shuffle; only windows with a second occurrence are looked at again."""
    found = stage(windows(docs, size), "windows")
    # the first place is a minimum over three plain numbers in a struct; one occurrence per row
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")
    totals = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = stage(
        totals.filter("first <> last").select(
            "hash", F.col("first.doc_id").alias("f_id"), F.col("first.key").alias("f_key"), F.col("first.at").alias("f_at")
        ),
        "repeated",
    )
    later = found.join(small(repeated, repeated.count()), "hash").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")) & (F.col("at") == F.col("f_at")))
    )
    return later.select("doc_id", "key", F.explode(F.sequence("at", "upto")).alias("at")).distinct()


def drop_repeated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, all columns, with text cut, and two more columns: lines, removed_lines.
    Documents that lose nothing are found by their key alone, and their texts do not shuffle while
    the others are few."""
    gone = covered_lines(docs, size)
    lists = stage(
        gone.groupBy(F.col("doc_id").alias("g_id"), F.col("key").alias("g_key")).agg(F.collect_set("at").alias("g_at")), "covered"
    )
    # the lists are as large as the lines they hold, so those are counted for the broadcast
    held = lists.agg(F.sum(F.size("g_at"))).first()[0] or 0
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").alias("own_id"), text_key(F.col("text")).alias("own_key"), F.col("text").alias("own_text"),
    )
    joined = own.join(
        small(lists, held), F.col("own_id").eqNullSafe(F.col("g_id")) & (F.col("own_key") == F.col("g_key")), "left"
    )
    lines, whole = lines_of(F.col("own_text")), F.col("own_text")
    count = F.coalesce(F.when(whole != "", F.size(lines)), F.lit(0)).alias("lines")
    removed = F.when(F.col("g_at").isNull(), F.lit(0)).otherwise(F.size("g_at")).alias("removed_lines")
    # the places that stay, by one pass over the lines and one over those that go
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("g_at"))
    cut = F.array_join(F.transform(stay, lambda at: F.get(F.col("parts"), at)), "\n")
    text = F.when(F.col("g_at").isNull(), whole).otherwise(cut).alias("text")
    others = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("text", "lines", "removed_lines")]
    parted = joined.withColumn("parts", F.when(F.col("g_at").isNotNull(), lines))
    made = parted.select("doc", F.struct(text, count, removed).alias("made"))  # before any column of the documents has its name
    return made.select(*others, "made.text", "made.lines", "made.removed_lines")
