"""Vector codes: parts of vectors as indexes into small integer codebooks, and their exact errors.

A component x counts as the integer floor(SCALE x). A vector is cut into PARTS equal consecutive parts;
each part position has a codebook of at most ENTRIES entries, at first that part of the vectors of
smallest id. A round gives every part its nearest entry (squared distance, ties to the lower index) and
moves each used entry to the componentwise floor of its parts' mean. After ROUNDS rounds the parts are
given their entries once more; these are the codes.

The nearest entry is found through a GNAT over a codebook: a node's split points know the least and
greatest distance to every child's points, and a query's distance to a split point rules out whole
children. A child goes only if all its points are farther than the best one, strictly and with
rounding on the safe side, so no tie is lost; what remains is compared in whole numbers. Sums of a
round are made per task and added up in groups of one entry; the driver holds the codebooks only.

Rows whose vector is NULL or holds NULL, NaN or infinity are left out. Vectors of other lengths
count as filled up with zeros, to the longest length and a multiple of PARTS. With fewer rows than
ENTRIES the codebooks have as many entries as rows; equal rows are entries of their own; of equal ids
the smaller vector comes first, NULL ids last. Components may have any finite size: large ones are
counted in unbounded whole numbers, and errors beyond a long are stated as the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import small
from shelfwise.sources.scratch import stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SPLITS = 4
SAFE = 2.0**-48  # relative rounding of roots and sums of distances, with room to spare
LONGEST = (1 << 63) - 1
ROWS = 4096  # rows that are coded together


def most_in_longs(width: int) -> int:
    """Components up to this size have squared distances that 64 bits hold."""
    return math.isqrt(LONGEST // (4 * max(1, width)))


def whole(vectors: list[np.ndarray], width: int, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale x), as 64-bit integers if no squared distance can leave them."""
    out = np.zeros((len(vectors), width))
    if len({len(v) for v in vectors}) == 1:
        out[:, : len(vectors[0])] = np.stack(vectors)
    else:
        for row, vector in zip(out, vectors, strict=True):
            row[: len(vector)] = vector
    if np.abs(out).max(initial=0) * scale < most_in_longs(width) - 1:
        return np.floor(out * scale).astype(np.int64)
    # the whole part and the rest by themselves, so that no product is rounded
    wide = np.empty(out.shape, object)
    wide[:] = [[math.floor(x) * scale + math.floor((x - math.floor(x)) * scale) for x in row] for row in out.tolist()]
    return wide


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = x - entry
    return (gap * gap).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    """Distances as floats; NaN, which rules out nothing, where a square is beyond them."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(x) if x < 1 << 1000 else math.nan for x in squares.tolist()], np.float64)


class Gnat:
    """The nearest of a codebook's entries, by split points and ranges of distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.met = 0  # distances computed
        self.far = np.array([roots(squared(entries, e)) for e in entries])
        self.root = self._node(list(range(len(entries))))

    def _node(self, own: list[int]) -> dict:
        splits = own[:1]
        while len(splits) < min(SPLITS, len(own)):  # the one farthest from all split points
            rest = [k for k in own if k not in splits]
            splits.append(max(rest, key=lambda k: (self.far[k, splits].min(), -k)))
        below: list[list[int]] = [[] for _ in splits]
        for k in own:
            if k not in splits:
                below[int(np.argmin(self.far[k, splits]))].append(k)
        low, high = np.full((len(splits),) * 2, np.inf), np.full((len(splits),) * 2, -np.inf)
        for i, split in enumerate(splits):
            for j, child in enumerate(below):
                points = child if i == j else [splits[j], *child]
                if points:
                    low[i, j], high[i, j] = self.far[split, points].min(), self.far[split, points].max()
        children = [self._node(c) if c else None for c in below]
        return {"splits": splits, "low": low, "high": high, "span": self.far[own][:, own].max(), "children": children}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        index = np.zeros(len(x), np.int64)
        wide = object in (x.dtype, self.entries.dtype)
        best = np.full(len(x), math.inf if wide else LONGEST, object if wide else np.int64)
        self._visit(self.root, x, np.arange(len(x)), index, best)
        return index, best

    def _visit(self, node: dict, x: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        # a column: the split point and its child; once it is measured, the child alone
        alive = np.ones((len(rows), len(node["splits"])), bool)
        for i, split in enumerate(node["splits"]):
            near = np.flatnonzero(alive[:, i])
            own = rows[near]
            distance = squared(x[own], self.entries[split])
            self.met += len(own)
            better = (distance < best[own]) | ((distance == best[own]) & (split < index[own]))
            index[own[better]], best[own[better]] = split, distance[better]
            off, reach = roots(distance)[:, None], roots(best[own])[:, None]
            least = np.maximum(off - node["high"][i], node["low"][i] - off)  # no point of the child is nearer
            alive[near] &= ~(least > reach + SAFE * (off + reach + node["span"]))
        for i, child in enumerate(node["children"]):
            if child is not None:
                self._visit(child, x, rows[alive[:, i]], index, best)


def _floats(values: np.ndarray) -> list[np.ndarray]:
    return [np.asarray([x for x in v], np.float64) for v in values]


def _coded(vectors: list[np.ndarray], books: list[np.ndarray], trees: list[Gnat]) -> tuple[np.ndarray, list, list]:
    """Codes (rows, parts), and per part the whole numbers and their squared distances."""
    width = len(books) * books[0].shape[1]
    numbers = whole(vectors, width)
    parts = np.split(numbers, len(books), axis=1)
    found = [tree.nearest(part) for part, tree in zip(parts, trees, strict=True)]
    return np.stack([k for k, _ in found], axis=1), parts, [d for _, d in found]


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first in range(0, len(frame), ROWS):
            yield frame.iloc[first : first + ROWS]


def _sums(books: list[np.ndarray]):
    """Per part and entry, the number of parts and their sums as text, once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(b) for b in books]
        count = np.zeros((len(books), len(books[0])), np.int64)
        total = [np.zeros(b.shape, object) for b in books]
        for frame in _slices(frames):
            codes, parts, _ = _coded(_floats(frame["vector"]), books, trees)
            for p, part in enumerate(parts):
                for k in np.unique(codes[:, p]):
                    own = codes[:, p] == k
                    count[p, k] += own.sum()
                    total[p][k] += np.array([int(x) for x in part[own].sum(axis=0)], object)
        used = np.argwhere(count > 0)
        yield pd.DataFrame(
            {
                "part": used[:, 0],
                "entry": used[:, 1],
                "n": count[used[:, 0], used[:, 1]],
                "total": [[str(x) for x in total[p][k]] for p, k in used],
            }
        )

    return run


def _mean(frame: pd.DataFrame) -> pd.DataFrame:
    n = int(frame["n"].sum())
    made = [str(sum(map(int, column)) // n) for column in zip(*frame["total"], strict=True)]
    return pd.DataFrame({"part": frame["part"].iloc[:1], "entry": frame["entry"].iloc[:1], "mean": [made]})


def _codes(books: list[np.ndarray]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Gnat(b) for b in books]
        for frame in _slices(frames):
            codes, _, errors = _coded(_floats(frame["vector"]), books, trees)
            yield pd.DataFrame(
                {
                    "vec_id": frame["vec_id"],
                    "label": frame["label"],
                    "code": ["".join(f"{k:02x}" for k in row) for row in codes.tolist()],
                    "error": [min(LONGEST, sum(map(int, e))) for e in zip(*errors, strict=True)],
                }
            )

    return run


def finite(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of (vec_id, vector), one array (entries, components) for each part position."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return []
    width = -(-longest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = np.split(whole(_floats([r.vector for r in first]), width), parts, axis=1)
    for _ in range(rounds):
        sums = rows.select("vector").mapInPandas(_sums(books), "part int, entry int, n long, total array<string>")
        means = sums.groupBy("part", "entry").applyInPandas(_mean, "part int, entry int, mean array<string>").collect()
        new = [b.astype(object) for b in books]
        for r in means:
            new[r.part][r.entry] = list(map(int, r["mean"]))
        most = max((abs(x) for b in new for x in b.flat), default=0)
        books = [b.astype(np.int64) for b in new] if most < most_in_longs(width) else new
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.flat).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of (vec_id, label, vector)."""
    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "vector").mapInPandas(_codes(books), f"vec_id long, label {kind}, code string, error long")


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error (of all rows of that label, NULL being one),
    codebooks_sha256 for rows of (vec_id, vector, label)."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, 1 part or more, 0 rounds or more")
    good = rows.filter(F.col("vector").isNotNull() & finite(F.col("vector"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("vector").cast("array<double>").alias("vector")
    )
    good = stage(good, "vectors")
    books = fit(good, parts, entries, rounds)
    if books:
        coded = encode(good, books)
    else:
        coded = good.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = stage(coded, "codes")
    sums = stage(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "label-errors")
    sums = sums.select(F.col("label").alias("l"), F.least("total", F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(small(sums, sums.count()), F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )
