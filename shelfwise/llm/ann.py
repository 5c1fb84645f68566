"""Nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one graph node that lists its smallest k + 1 ids, which is all that a search for k
can return of them, so a vector that half the table holds is one node. Nodes are dealt by a hash into
shards of about SHARD_ROWS; a shard's graph is one row of flat arrays (vectors, neighbours per
level, ids), written as a table. Queries go in blocks to every shard; the best k of every shard are
merged, by exact distance in doubles, ties to the smaller id.

Vectors that are NULL, zero, empty, or hold NULL, NaN or infinity take no part, nor do NULL ids.
Equal rows count once. A query meets vectors of its own length only, and never rows of its own id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.sources.scratch import stage

SHARD_ROWS = 8192
QUERY_BLOCK = 512
LINKS = 16  # per node and upper level; twice as many on the lowest
WIDTH_BUILD = 80
WIDTH_SEARCH = 200


class Graph:
    """The graph over the rows of `vectors`. links[level] is (rows, width), -1 where free."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors = vectors.astype(np.float32)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.links, self.entry = links or [], entry
        self.mark = np.zeros(len(vectors), np.int64)  # the search that last met a node
        self.turn = 0

    def build(self, seed: int = 1) -> Graph:
        n = len(self.vectors)
        level = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        self.links = [np.full((n, LINKS * (1 if k else 2)), -1, np.int32) for k in range(max(level, default=0) + 1)]
        top = level[0] if n else 0
        for node in range(1, n):
            point = self.vectors[node]
            near = [(self._distance(point, np.array([self.entry]))[0], self.entry)]
            for k in range(top, level[node], -1):
                near = self._search(point, near, 1, k)
            for k in range(min(top, level[node]), -1, -1):
                near = self._search(point, near, WIDTH_BUILD, k)
                whole = np.array([d for d, _ in near]) + self.norms[node]
                chosen = self._diverse(np.array([x for _, x in near]), whole, LINKS)
                self.links[k][node, : len(chosen)] = chosen
                for other in chosen.tolist():
                    self._connect(other, node, k)
            if level[node] > top:
                top, self.entry = level[node], node
        return self

    def _distance(self, point: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.norms[rows] - 2 * (self.vectors[rows] @ point)  # squared, less the point's own norm

    def _diverse(self, rows: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
        """Of rows by distance, those nearer to the point than to any chosen one; then the nearest."""
        if len(rows) <= most:
            return rows
        own = self.vectors[rows]
        pair = self.norms[rows][:, None] - 2 * (own @ own.T) + self.norms[rows][None, :]
        apart = np.full(len(rows), np.inf, np.float32)
        chosen: list[int] = []
        for k in range(len(rows)):
            if distance[k] < apart[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                np.minimum(apart, pair[k], out=apart)
        if len(chosen) < most:
            rest = np.setdiff1d(np.arange(len(rows)), chosen, assume_unique=True)
            chosen += rest[: most - len(chosen)].tolist()
        return rows[chosen]

    def _connect(self, node: int, new: int, level: int) -> None:
        own = self.links[level][node]
        free = np.flatnonzero(own < 0)
        if len(free):
            own[free[0]] = new
            return
        rows = np.append(own, new)
        distance = self._distance(self.vectors[node], rows) + self.norms[node]
        order = np.argsort(distance)
        chosen = self._diverse(rows[order], distance[order], len(own))
        own[:] = -1
        own[: len(chosen)] = chosen

    def _search(self, point: np.ndarray, start: list, width: int, level: int) -> list:
        """The `width` nearest found on a level, nearest first, as (distance, row)."""
        self.turn += 1
        mark, turn, links = self.mark, self.turn, self.links[level]
        for _, row in start:
            mark[row] = turn
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, row) for d, row in start]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            d, row = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            rows = links[row]
            rows = rows[rows >= 0]
            rows = rows[mark[rows] != turn]
            if not len(rows):
                continue
            mark[rows] = turn
            for e, other in zip(self._distance(point, rows).tolist(), rows.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, other))
                    heapq.heappush(todo, (e, other))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, other))
                    heapq.heappush(todo, (e, other))
        return sorted((-d, row) for d, row in best)

    def nearest(self, point: np.ndarray, width: int) -> np.ndarray:
        """Rows near the point, at most `width`."""
        point = point.astype(np.float32)
        near = [(self._distance(point, np.array([self.entry]))[0], self.entry)]
        for k in range(len(self.links) - 1, 0, -1):
            near = self._search(point, near, 1, k)
        return np.array([row for _, row in self._search(point, near, width, 0)])


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """One row per different vector of (vec_id, vector): vector, ids (the smallest k + 1)."""
    own = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("vector", lambda x: x.cast("double") + 0.0).alias("vector")
    )
    rank = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    return (
        own.distinct()
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    )


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("first")  # the same graph on every run
    vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64)
    graph = Graph(vectors).build()
    return pd.DataFrame(
        {
            "dim": [vectors.shape[1]],
            "shard": [int(frame["shard"].iat[0])],
            "vectors": [vectors.tobytes()],
            "links": [[x.tobytes() for x in graph.links]],
            "entry": [graph.entry],
            "ids": [np.concatenate(frame["ids"].to_numpy()).astype(np.int64).tobytes()],
            "counts": [frame["ids"].map(len).to_numpy(np.int64).tobytes()],
        }
    )


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The shards' graphs, one row each, written as a table."""
    made = stage(nodes(rows, k).withColumn("dim", F.size("vector")), "vectors")
    shards = max(1, -(-made.count() // shard_rows))
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).withColumn("first", F.col("ids")[0])
    return stage(
        dealt.groupBy("dim", "shard").applyInPandas(
            _build,
            "dim int, shard int, vectors binary, links array<binary>, entry int, ids binary, counts binary",
        ),
        "graphs",
    )


def _searcher(k: int, width: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if index.empty or queries.empty:
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        row = index.iloc[0]
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        links = [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in row["links"]]
        counts = np.frombuffer(row["counts"], np.int64)
        ids, first = np.frombuffer(row["ids"], np.int64), np.cumsum(counts) - counts
        graph = Graph(vectors, links, int(row["entry"]))
        out = []
        for query_id, vector in zip(queries["query_id"].to_numpy(), queries["vector"], strict=True):
            point = np.asarray(vector, np.float64)
            near = graph.nearest(point, max(width, 2 * k))
            exact = np.sqrt(((vectors[near] - point) ** 2).sum(axis=1))
            found = [
                (d, i)
                for d, node in zip(exact.tolist(), near.tolist(), strict=True)
                for i in ids[first[node] : first[node] + counts[node]].tolist()
                if i != query_id
            ]
            out += [(query_id, i, d) for d, i in heapq.nsmallest(k, found)]
        return pd.DataFrame(out, columns=columns)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, width: int = WIDTH_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score for queries of (vec_id, vector) against rows of the same."""
    index = build_index(rows, k)
    wanted = queries.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(
        F.col("vec_id").cast("long").alias("query_id"),
        F.transform("vector", lambda x: x.cast("double") + 0.0).alias("vector"),
        F.size("vector").alias("dim"),
    )
    wanted = stage(wanted.distinct(), "queries")
    parts = max(1, -(-wanted.count() // QUERY_BLOCK))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    # every block of queries meets every shard: both sides are repeated by a counted sequence
    asked = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["dim", "shard", "block"]
    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        _searcher(k, width), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
