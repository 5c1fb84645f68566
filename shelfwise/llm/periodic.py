"""Periodic runs of words: maximal stretches that repeat with a period, and texts without the repeats.

Words are the runs of characters outside [\\x20\\x09-\\x0D], numbered from 0. A run is a stretch of
words with smallest period q (words q apart are identical) and a length of max(MIN_WORDS, 2 q) or
more that no neighbouring word extends at that period. All runs are found, exactly:

1. Words become numbers, equal where the words are. Texts are worked on in blocks; a mark that occurs
   once stands around every text, so nothing reaches over its end.
2. A run of period p holds p or more places whose word equals the one p later, so it holds a multiple
   of p (of MIN_WORDS - p for short periods) among them. These places of all periods, a harmonic
   series of n log n, are looked at; where three words beside agree as well, a run may be.
3. Recompression turns the words of these texts into a run-length grammar: stretches of one symbol
   become one symbol each (block compression), then neighbours from two halves of the alphabet become
   one symbol (pair compression), and so on until little is left. Equal stretches are cut in the same
   way but for their ends, so the longest common extension of two places climbs the grammar while
   symbols agree and descends where they do not, in a logarithmic number of steps.
4. A candidate's extensions to both sides give the whole run. Of the periods of one stretch the
   smallest stays.

NULL and wordless texts have no words, no runs, and an empty collapsed text. Rows are treated one by
one; a document is never split, and its work grows with n log n of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import blocks, bounded_batches, mix64

MIN_WORDS = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PAIRS = 2_000_000  # places of the harmonic grid that are looked at together
BESIDE = 3  # of a run's agreeing places, 6 or more in a row, three follow or precede each
FEW = 32  # symbols of a grammar's last level, beside two for each text


def numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers, one mark before, between and after the texts; where each text begins and
    how many words it has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat, _ = pd.factorize(np.array([w for words in texts for w in words], dtype=object))
    begins = np.cumsum(sizes) - sizes + np.arange(1, len(texts) + 1)
    out = np.arange(sizes.sum(), sizes.sum() * 2 + len(texts) + 1)  # numbers that no word has
    out[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
    return out, begins, sizes


def candidates(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the harmonic grid where a run may be."""
    most = np.where(sizes >= MIN_WORDS, sizes // 2, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(1, len(text) + 1) - np.repeat(np.cumsum(most) - most, most)
    step = np.maximum(period, MIN_WORDS - period)
    count = -(-(sizes[text] - period) // step)
    ends = np.cumsum(count)
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    first = 0
    while first < len(text):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        own = slice(first, last)
        nth = np.arange(ends[last - 1] - done) - np.repeat(ends[own] - count[own] - done, count[own])
        at = np.repeat(begins[text[own]], count[own]) + nth * np.repeat(step[own], count[own])
        apart = np.repeat(period[own], count[own])
        same = words[at] == words[at + apart]
        at, apart = at[same], apart[same]
        keep = np.zeros(len(at), bool)
        for side in (1, -1):
            all_same = np.ones(len(at), bool)
            for k in range(1, BESIDE + 1):
                inside = (at + side * k >= 0) & (at + apart + side * k < len(words))
                left = np.where(inside, at + side * k, 0)
                all_same &= inside & (words[left] == words[np.where(inside, left + apart, 0)])
            keep |= all_same
        places.append(at[keep])
        periods.append(apart[keep])
        first = last
    return np.concatenate(places), np.concatenate(periods)


class Grammar:
    """Levels of recompression over numbers that end with one that occurs once.

    symbols[k] is level k. For k > 0, parent[k - 1] is the symbol of level k over each symbol of
    level k - 1, and first[k] the first symbol of level k - 1 below each. stop[k - 1], for levels
    made by block compression, is where the block of a symbol ends.
    """

    def __init__(self, words: np.ndarray, texts: int):
        self.symbols = [words]
        self.parent: list[np.ndarray] = []
        self.first: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.stop: list[np.ndarray | None] = []
        while len(self.symbols[-1]) > 2 * texts + FEW and len(self.parent) < 200:
            self._blocks(self.symbols[-1])
            self._pairs(self.symbols[-1])

    def _add(self, begins: np.ndarray, names: np.ndarray, stop: np.ndarray | None) -> None:
        new = np.zeros(len(self.symbols[-1]), np.int64)
        new[begins] = 1
        self.parent.append(np.cumsum(new) - 1)
        self.first.append(np.flatnonzero(new))
        self.stop.append(stop)
        self.symbols.append(np.unique(names, return_inverse=True)[1])

    def _blocks(self, now: np.ndarray) -> None:
        begins = np.flatnonzero(np.concatenate([[True], now[1:] != now[:-1]]))
        sizes = np.diff(np.append(begins, len(now)))
        stop = np.repeat(begins + sizes, sizes)
        self._add(begins, now[begins] * (sizes.max() + 1) + sizes, stop)

    def _pairs(self, now: np.ndarray) -> None:
        level = np.uint64(len(self.symbols))
        right = (mix64(now.astype(np.uint64) + (level << np.uint64(40))) & np.uint64(1)).astype(bool)
        joined = np.append(~right[:-1] & right[1:], False)  # first of a pair
        begins = np.flatnonzero(~np.concatenate([[False], joined[:-1]]))
        follower = np.where(joined, np.append(now[1:], 0) + 1, 0)
        self._add(begins, now[begins] * (now.max() + 2) + follower[begins], None)

    def _step(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far equal symbols of a level may be passed together."""
        stop = self.stop[level] if level < len(self.stop) else None
        return 1 if stop is None else np.minimum(stop[x] - x, stop[y] - y)

    def extension(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """How many numbers agree from each place of `one` and of `two` on. Every pair must meet a
        number that occurs once before the end."""
        x, y = one.copy(), two.copy()
        turn = np.full(len(x), -1)
        top = len(self.symbols) - 1
        up = np.arange(len(x))
        for level in range(top + 1):
            now = self.symbols[level]
            todo = up
            while True:
                if level < top:  # where both begin a symbol of the next level, go up
                    below, above = self.parent[level], self.first[level + 1]
                    todo = todo[(above[below[x[todo]]] != x[todo]) | (above[below[y[todo]]] != y[todo])]
                if not len(todo):
                    break
                same = now[x[todo]] == now[y[todo]]
                turn[todo[~same]] = level
                todo = todo[same]
                step = self._step(level, x[todo], y[todo])
                x[todo] += step
                y[todo] += step
            up = up[turn[up] < 0]
            if level < top:
                x[up], y[up] = self.parent[level][x[up]], self.parent[level][y[up]]
        for level in range(top, 0, -1):
            down = np.flatnonzero(turn >= level)
            x[down], y[down] = self.first[level][x[down]], self.first[level][y[down]]
            now = self.symbols[level - 1]
            while len(down):
                down = down[now[x[down]] == now[y[down]]]
                step = self._step(level - 1, x[down], y[down])
                x[down] += step
                y[down] += step
        return x - one


def runs_of_texts(texts: list[list[str]]) -> list[np.ndarray]:
    """For each text of words: its runs as rows of start, length, period, by start, then period."""
    words, begins, sizes = numbered(texts)
    at, period = candidates(words, begins, sizes)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    if not len(at):
        return out
    # the grammar is over the texts with a candidate
    owner = np.searchsorted(begins, at, side="right") - 1
    wanted = np.unique(owner)
    own, own_begins, _ = numbered([texts[k] for k in wanted])
    at = at - begins[owner] + own_begins[np.searchsorted(wanted, owner)]
    after = Grammar(own, len(wanted)).extension(at, at + period)
    back = len(own) - at
    before = Grammar(own[::-1].copy(), len(wanted)).extension(back, back - period)
    length = before + after + period
    good = length >= np.maximum(MIN_WORDS, 2 * period)
    start, length, period = (at - before)[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    text = np.searchsorted(own_begins, start, side="right") - 1
    found = np.stack([start - own_begins[text], length, period], axis=1)
    cuts = np.searchsorted(text, np.arange(len(wanted) + 1))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        out[wanted[k]] = found[a:b]
    return out


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words without those that a run contains after its first period."""
    if not len(runs):
        return " ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return " ".join([words[k] for k in kept.tolist()])


def _find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        made: dict[str, list] = {"n_words": [], "start": [], "length": [], "period": [], "collapsed": []}
        for part in blocks(texts.to_frame("text"), "text"):
            own = [WORD.findall(t) if isinstance(t, str) else [] for t in part["text"]]
            for words, runs in zip(own, runs_of_texts(own), strict=True):
                made["n_words"].append(len(words))
                made["start"].append(runs[:, 0])
                made["length"].append(runs[:, 1])
                made["period"].append(runs[:, 2])
                made["collapsed"].append(collapsed(words, runs))
        yield pd.DataFrame(made)


FOUND = "n_words long, start array<long>, length array<long>, period array<long>, collapsed string"


def find_runs(text: Column) -> Column:
    """A struct: n_words; start, length and period of every run, by start, then period; collapsed."""
    return F.pandas_udf(_find, FOUND)(text)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text): doc_id, n_words, runs (array of start, length, period),
    collapsed (the text without repeats, its words joined by one space)."""
    bounded_batches(docs.sparkSession)
    made = docs.select("doc_id", find_runs(F.col("text")).alias("r"))
    return made.select(
        "doc_id", "r.n_words", F.arrays_zip("r.start", "r.length", "r.period").alias("runs"), "r.collapsed"
    )
