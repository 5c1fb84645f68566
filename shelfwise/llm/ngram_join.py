"""Join of similar texts on word n-grams: MinHash banding, then exact Jaccard on whole n-gram sets.

1. Per document: the set of hashed 5-word shingles, its 64-bit key, and one hash per band. Bands and
   rows follow from the wanted recall at the threshold (choose_bands).
2. Documents with the same set form one class; copies are never compared again. (64-bit keys: about
   25 accidental merges are expected among 3e10 different texts.)
3. Band hashes shuffle; classes of one bucket hang on its least class, and the connected components
   of that are the candidate clusters. Two classes that share a band are always in one cluster.
4. Only texts of clusters are read again. A cluster is dealt into blocks of about BLOCK classes and
   every pair of blocks is one task, so a large cluster spreads. A task counts the common shingles
   of all its pairs and returns per class the number of links and one edge to its local group: no
   list of pairs leaves a task, and no link is left out.
5. Components of the verified edges are the groups; a document's class_id is the least doc_id there.

Words are runs of letters and digits of the lower-cased text. A text of one to four words has one
shingle, all its words. A text without words (or NULL) is a group of its own with no links. Rows
equal in id and text count as two documents of one class. A group with no id at all has class_id
NULL; ids that are NULL come last otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import blocks, bounded_batches, mix64, small, text_key
from shelfwise.llm.graph import components
from shelfwise.llm.words import runs_of
from shelfwise.sources.scratch import stage

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
MAX_HASHES = 160
BLOCK = 256
# Shingles of a task's vocabulary that are counted at once.
COLUMNS = 4096
SEED = 20240607


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows per band with which enough bands for that recall still fit.
    A pair at the threshold shares a band with probability 1 - (1 - s^rows)^bands."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of all texts, sorted and distinct per text, and the start of each text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    runs = runs_of(texts)
    word, per_doc = runs.hash, runs.per_text
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    begin = np.cumsum(per_doc) - per_doc
    count = np.where(per_doc == 0, 0, np.maximum(1, per_doc - words + 1))
    owner = np.repeat(np.arange(len(texts)), count)
    start = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    hashed = np.zeros(len(start), np.uint64)
    stop = (begin + per_doc)[owner]
    for k in range(words):
        reach = start + k
        some = word[np.minimum(reach, len(word) - 1)]
        hashed = mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + np.where(reach < stop, some, np.uint64(k + 1)))
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


def band_hashes(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) for texts that have shingles, numbered as they come."""
    filled = starts[:-1][np.diff(starts) > 0]
    if not len(filled):
        return np.zeros((0, bands), np.int64)
    draw = np.random.default_rng(SEED + 1)
    factor = draw.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offset = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    out = np.empty((len(filled), bands), np.uint64)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for band in range(bands):
        key = np.full(len(filled), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            value = (low ^ offset[k]) * factor[k]
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, filled))
        out[:, band] = key
    return out.view(np.int64)


def set_keys(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text's set; texts without shingles are left out."""
    sizes = np.diff(starts)
    filled = starts[:-1][sizes > 0]
    if not len(filled):
        return np.zeros(0, np.int64)
    one = np.add.reduceat(mix64(shingles + np.uint64(0xA0761D6478BD642F)), filled)
    return mix64(one + sizes[sizes > 0].astype(np.uint64)).view(np.int64)


def _sketch(bands: int, rows: int, words: int):
    def run(texts: pd.Series) -> pd.DataFrame:
        keys: list = []
        sketches: list = []
        for part in blocks(texts.to_frame("text"), "text"):
            own = [t if isinstance(t, str) else "" for t in part["text"]]
            shingles, starts = shingle_sets(own, words)
            found = iter(zip(set_keys(shingles, starts).tolist(), band_hashes(shingles, starts, bands, rows), strict=True))
            for size in np.diff(starts):
                key, sketch = next(found) if size else (None, None)
                keys.append(key)
                sketches.append(sketch)
        return pd.DataFrame({"cls": pd.Series(keys, dtype="Int64"), "bands": pd.Series(sketches, dtype=object)})

    return F.pandas_udf(run, "cls long, bands array<long>")


def digests(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, text_key, cls (NULL without words), bands; written once."""
    bounded_batches(docs.sparkSession)
    made = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        _sketch(bands, rows, words)(F.col("text")).alias("s"),
    )
    return stage(made.select("doc_id", "text_key", "s.cls", "s.bands"), "sketches")


def _classes(rows: DataFrame) -> DataFrame:
    """cls, size, and one document that stands for it."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    return stage(
        rows.filter("cls IS NOT NULL")
        .groupBy("cls", "doc_id", "text_key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cls")
        .agg(F.sum("n").alias("size"), F.min(first).alias("rep"))
        .select("cls", "size", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")),
        "classes",
    )


def candidate_edges(rows: DataFrame) -> DataFrame:
    """Classes of one bucket hang on its least class."""
    buckets = stage(
        rows.filter("cls IS NOT NULL").select(F.explode("bands").alias("band"), "cls").distinct(), "buckets"
    )
    # buckets of one class, by far the most, end here
    least = buckets.groupBy("band").agg(F.min("cls").alias("least"), F.max("cls").alias("most"))
    least = stage(least.filter("least < most").select("band", "least"), "least")
    return buckets.join(small(least, least.count()), "band").filter("cls <> least").select(
        F.col("cls").alias("a"), F.col("least").alias("b")
    )


def common_counts(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of shingles that two sets share; the diagonal is the sizes."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set adds nothing to a pair
    column, owner = column[shared], owner[shared]
    out = np.zeros((n, n), np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        cuts = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[lo:hi], column[lo:hi] - k * COLUMNS] = 1
            out += part @ part.T
    np.fill_diagonal(out, sizes)
    return out


def _groups(linked: np.ndarray) -> np.ndarray:
    """Least member of each row's connected group, for a symmetric matrix of links."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(linked)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("cls").sort_values("cls", ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        common = common_counts(sets, size)
        linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        block = frame["block"].to_numpy()
        if frame["lo"].iat[0] != frame["hi"].iat[0]:  # pairs inside a block belong to its own task
            linked &= block[:, None] != block[None, :]
        copies = frame["size"].to_numpy()
        return pd.DataFrame(
            {
                "cls": frame["cls"],
                "hub": frame["cls"].to_numpy()[_groups(linked)],
                "texts": linked.sum(axis=1),
                "docs": linked @ copies,
            }
        )

    return run


def similar_groups(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL
) -> DataFrame:
    """Per document of (doc_id, text): doc_id, text_key, class_id, class_key (which document gives
    the id), group_size, n_links (other documents at that similarity or more, copies too),
    n_text_links (other texts)."""
    rows = digests(docs, *choose_bands(similarity, recall), words)
    classes = _classes(rows)
    roots = components(candidate_edges(rows))
    clustered = roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct())
    sizes = clustered.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    members = stage(
        clustered.withColumnRenamed("a", "cls").join(sizes, "root").join(classes, "cls")
        .withColumn("block", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("parts")).cast("int")),
        "members",
    )
    checked = _checked(docs, members, similarity, words)
    hung = components(checked.filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    links = checked.groupBy("cls").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    info = (
        classes.join(links, "cls", "left")
        .join(hung.withColumnRenamed("a", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    info = stage(info, "links")
    first = F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "rep_key")
    groups = info.groupBy("root").agg(F.min(first).alias("rep"), F.sum("size").alias("group_size"))
    found = stage(
        info.join(groups, "root").select(
            "cls", "size", "group_size", "texts", "docs",
            F.col("rep.rep_id").alias("class_id"), F.col("rep.rep_key").alias("class_key"),
        ),
        "found",
    )
    known, alone = F.col("size").isNotNull(), F.lit(0).cast("long")
    return rows.drop("bands").join(found, "cls", "left").select(
        "doc_id",
        "text_key",
        F.when(known, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(known, F.col("class_key")).otherwise(F.col("text_key")).alias("class_key"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("size") - 1 + F.coalesce("docs", alone), alone).alias("n_links"),
        F.coalesce("texts", alone).alias("n_text_links"),
    )


def _checked(docs: DataFrame, members: DataFrame, similarity: float, words: int) -> DataFrame:
    """cls, hub, texts, docs per class and pair of blocks, from the whole texts of the clusters."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in blocks(frame, "text"):
                shingles, starts = shingle_sets([t if isinstance(t, str) else "" for t in part["text"]], words)
                raw = [shingles[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield part.drop(columns="text").assign(shingles=raw)

    wanted = members.select("cls", "size", "root", "parts", "block", "rep_id", "rep_key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = texts.join(
        small(wanted, wanted.count()),
        F.col("doc_id").eqNullSafe(F.col("rep_id")) & (text_key(F.col("text")) == F.col("rep_key")),
    ).select("cls", "size", "root", "parts", "block", "text")
    made = joined.mapInPandas(sets, "cls long, size long, root long, parts int, block int, shingles binary")
    paired = made.select(
        "cls", "size", "root", "block", "shingles",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
    )
    keyed = paired.select(
        "cls", "size", "root", "block", "shingles",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    )
    return stage(
        keyed.groupBy("root", "lo", "hi").applyInPandas(_verify(similarity), "cls long, hub long, texts long, docs long"),
        "checked",
    )


def keep_one_of_similar(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One document of each group stays, the one with the least doc_id; all columns, by any names.
    Of rows equal in id and text one stays. Texts without words (NULL, empty) all stay."""
    found = similar_groups(docs, similarity, words)
    rest = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    gone = stage(found.filter(~rest).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone")
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("doc_id").cast("long").alias("own_id"),
        text_key(F.col("text")).alias("own_key"),
    )
    same = lambda other: F.col("own_id").eqNullSafe(F.col(f"{other}_id")) & (F.col("own_key") == F.col(f"{other}_key"))
    left = own.join(small(gone, gone.count()), same("gone"), "left_anti")
    again = (
        found.filter(rest & (F.col("group_size") > 1))
        .groupBy(F.col("doc_id").alias("again_id"), F.col("text_key").alias("again_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    again = stage(again, "again")
    repeated = again.count()
    if not repeated:
        return left.select("doc.*")
    once = left.join(small(again, repeated), same("again"), "left_anti").select("doc")
    several = left.join(small(again, repeated), same("again"), "left_semi").dropDuplicates(["own_id", "own_key"]).select("doc")
    return once.unionByName(several).select("doc.*")
