"""Split texts into words by the pattern of byte-level vocabularies, and remember words' ids.

The pattern (fixed): 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Splitting works on whole blocks of text at once: runs of one character class, plus the rules for a
leading space, for blanks before a word, and for contractions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from shelfwise.llm.common import code_points, mix64, worker_cache

CACHED_WORDS = 400_000
LETTER, NUMBER, BLANK, OTHER, END = 0, 1, 2, 3, 4


def class_table() -> np.ndarray:
    """The class of each code point, by the Unicode data of the regex library."""
    cache = worker_cache("classes")
    if "of" not in cache:
        import regex

        out = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for found in regex.finditer(pattern, every):
                out[found.start() : found.end()] = kind
        cache["of"] = out
    return cache["of"]


def split_words(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin in the joined texts, for texts at starts[k]..starts[k + 1]."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[codes]
    first = np.zeros(n + 1, bool)  # first character of a text
    first[starts] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[n] = True
    following = np.full(n, END, np.uint8)  # class of the next character within the text
    following[:-1] = np.where(first[1:n], END, kind[1:])
    begin = run[:n].copy()
    # the last blank of a run before a word leaves the run: a space joins the word, another stays alone
    last = (kind == BLANK) & (following != BLANK) & (following != END)
    begin |= last
    joins = np.flatnonzero(last & (codes == 32))
    begin[joins + 1] = False
    # contractions: an apostrophe alone in its run, no space joined to it, and certain letters
    alone = np.flatnonzero((codes == 39) & run[:n] & (following == LETTER))
    alone = alone[begin[alone]]
    if len(alone):
        one = codes[alone + 1]
        two = np.where(alone + 2 < n, codes[np.minimum(alone + 2, n - 1)], 0)
        two = np.where(first[np.minimum(alone + 2, n)], 0, two)
        s, t, m, d, r, v, e, el = (ord(x) for x in "stmdrvel")
        short = (one == s) | (one == t) | (one == m) | (one == d)
        long = (((one == r) | (one == v)) & (two == e)) | ((one == el) & (two == el))
        begin[alone[short | long] + 1] = False
        for at in (alone[short] + 2, alone[long & ~short] + 3):
            at = at[at < n]
            begin[at] |= kind[at] == LETTER  # the rest of the letters is a word of its own
    return np.flatnonzero(begin)


def _factors(place: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """An odd number for each place, from the table and beyond it from a hash of the whole place."""
    out = odd[place & (len(odd) - 1)]
    far = np.flatnonzero(place >= len(odd))
    out[far] = mix64(place[far].astype(np.uint64)) | np.uint64(1)
    return out


def word_hashes(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; two of a million words share one with probability 3e-8."""
    lengths = np.diff(np.append(begins, len(codes)))
    odd = np.random.default_rng(97).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    place = np.arange(len(codes)) - np.repeat(begins, lengths)
    value = (codes.astype(np.uint64) + np.uint64(1)) * _factors(place, odd)
    return mix64(np.add.reduceat(value, begins) + lengths.astype(np.uint64))


def word_chars() -> np.ndarray:
    """For each code point: is it a letter or digit."""
    cache = worker_cache("word_chars")
    if "is" not in cache:
        cache["is"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return cache["is"]


@dataclass
class Runs:
    """Runs of letters and digits of lower-cased texts, one text after another."""

    codes: np.ndarray  # all characters
    first: np.ndarray  # where each run begins in them
    length: np.ndarray
    hash: np.ndarray  # 64 bits
    per_text: np.ndarray  # runs of each text
    starts: np.ndarray  # where each text begins in codes


def runs_of(texts: list[str]) -> Runs:
    codes, starts = code_points([t.lower() + " " for t in texts])
    inside = word_chars()[codes]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a run's begin and end by turns, as each text ends outside
    if len(inside) and inside[0]:
        edges = np.append(0, edges)
    if not len(edges):
        none = np.zeros(0, np.int64)
        return Runs(codes, none, none, np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), starts)
    first = edges[::2]
    length = edges[1::2] - first
    # a word's hash: the sum of its characters times a random odd number for their place
    odd = np.random.default_rng(20240607).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = np.cumsum(length) - length
    place = np.arange(offset[-1] + length[-1])
    place -= np.repeat(offset, length)
    value = odd.take(place) if length.max() <= len(odd) else _factors(place, odd)
    value *= codes[inside]
    hashed = mix64(np.add.reduceat(value, offset))
    return Runs(codes, first, length, hashed, np.diff(np.searchsorted(first, starts)), starts)


class _Known:
    """Words and their ids: sorted keys with a slot each, the ids of all slots in one array."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.slot = np.insert(self.slot, at, len(self.size) + order)
        self.keys = np.insert(self.keys, at, keys[order])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these slots one after another, and where each ends."""
        size = self.size[slots]
        offset = (np.cumsum(self.size) - self.size)[slots]
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        return self.flat[np.repeat(offset - (done - size), size) + np.arange(total)], done


class WordTable:
    """Ids of texts through the ids of their words. Up to CACHED_WORDS are remembered, in two
    generations: when the newer is full it becomes the older one, and words still in use go over.

    encode_words gives the number of ids of each word, and all ids one after another."""

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_words = encode_words
        self.now, self.before = _Known(), _Known()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the start of each text in them."""
        codes, starts = code_points(texts)
        begins = split_words(codes, starts)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        which, keys = pd.factorize(word_hashes(codes, begins))
        if len(self.now.keys) + len(keys) > CACHED_WORDS // 2:
            self.now, self.before = _Known(), self.now
        slots = self.now.find(keys)
        missing = np.flatnonzero(slots < 0)
        older = self.before.find(keys[missing])
        again, new = missing[older >= 0], missing[older < 0]
        if len(again):
            own = older[older >= 0]
            self.now.add(keys[again], self.before.size[own], self.before.ids(own)[0])
        if len(new):
            sample = np.zeros(len(keys), np.int64)
            sample[which[::-1]] = np.arange(len(which))[::-1]
            stops = np.append(begins[1:], len(codes))
            joined, at = "".join(texts), sample[new]
            spans = zip(begins[at].tolist(), stops[at].tolist(), strict=True)
            size, flat = self.encode_words([joined[a:b] for a, b in spans])
            self.now.add(keys[new], size, flat)
        if len(missing):
            slots = self.now.find(keys)
        ids, done = self.now.ids(slots[which])
        return ids, np.append(0, done)[np.searchsorted(begins, starts)]


def listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as sizes and one array."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return size, np.fromiter((i for own in ids for i in own), np.uint32, int(size.sum()))
