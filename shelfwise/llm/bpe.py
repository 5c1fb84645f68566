"""Byte-level BPE encoding and decoding by a rank file.

Every word (see words.py) is merged on a segment tree over its byte positions: a leaf holds the rank
of the pair that starts there, the root the least rank with its leftmost place. A merge changes
three leaves, the pair itself, the one before and the dead one behind, and their paths to the root.
Words of a batch with similar lengths go through their trees side by side in numpy; a long word has
a tree of its own. A word that is itself in the file is one id, as the tiktoken library has it.

NULL text is empty: no ids. Ids decode to the bytes they stand for, whatever text they came from.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.llm.common import blocks, worker_cache
from shelfwise.llm.words import WordTable, listed

SIDE_BY_SIDE = 64  # bytes; longer words have a tree of their own
NONE = 1 << 30
WORDS_AT_ONCE = 50_000


class Ranks:
    """The rank file, and the table of pairs: which two ids merge into which."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.words = WordTable(lambda words: listed(self.encode_words(words)))
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.rank.values()) + 1
        known = self.rank
        pairs = {}
        for token, merged in known.items():
            for cut in range(1, len(token)):
                left, right = known.get(token[:cut]), known.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = merged
        self.pairs = pairs
        # open addressing, so that numpy looks up many pairs at once
        self.mask = (1 << (len(pairs) * 4).bit_length()) - 1
        self.key = np.full(self.mask + 1, -1, np.int64)
        self.value = np.full(self.mask + 1, NONE, np.int64)
        keys, values = np.array([*pairs, -1][:-1], np.int64), np.array([*pairs.values()], np.int64)
        at = self._place(keys)
        while len(keys):
            free = self.key[at] < 0
            _, winner = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            winner = winner[free[winner]]
            self.key[at[winner]], self.value[at[winner]] = keys[winner], values[winner]
            left = np.ones(len(keys), bool)
            left[winner] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask
        tokens = sorted((rank, token) for token, rank in known.items())
        self.blob = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        self.length = np.zeros(self.base, np.int64)
        self.length[[r for r, _ in tokens]] = [len(t) for _, t in tokens]
        self.offset = np.cumsum(self.length) - self.length
        self.decimal = [str(i) for i in range(self.base)]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id two ids merge into, NONE where they don't. The id is the rank."""
        keys = left * self.base + right
        at = self._place(keys)
        got = self.key[at]
        out = np.where(got == keys, self.value[at], NONE)
        more = np.flatnonzero((got != keys) & (got >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            got = self.key[at[more]]
            hit = got == keys[more]
            out[more[hit]] = self.value[at[more[hit]]]
            more = more[~hit & (got >= 0)]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        groups: dict[int, list[int]] = {}
        raw = []
        for k, word in enumerate(words):
            data = word.encode("utf-8", "surrogatepass")
            raw.append(data)
            whole = self.rank.get(data)
            out.append(None if whole is None else [whole])
            if whole is None:
                size = 1 << max(2, (len(data) - 1).bit_length())
                if size <= SIDE_BY_SIDE:
                    groups.setdefault(size, []).append(k)
                else:
                    out[k] = self.merge_one(data)
        for size, members in groups.items():
            for first in range(0, len(members), WORDS_AT_ONCE):
                some = members[first : first + WORDS_AT_ONCE]
                for k, ids in zip(some, self.merge_many([raw[k] for k in some], size), strict=True):
                    out[k] = ids
        return out

    def merge_many(self, words: list[bytes], size: int) -> list[list[int]]:
        """Words of at most `size` bytes (a power of two), each on its own tree, side by side."""
        n, levels = len(words), size.bit_length() - 1
        lengths = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(size) < lengths[:, None]
        # one more place than bytes: the end, which is also what stands before the first byte
        token = np.zeros((n, size + 1), np.int64)
        token[:, :size][inside] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.minimum(np.arange(1, size + 2), lengths[:, None])
        after[after == lengths[:, None]] = size
        before = np.tile(np.arange(-1, size), (n, 1))
        before[:, 0] = size
        live = inside.copy()
        tree = np.full((n, 2 * size), NONE, np.int64)
        pair = inside[:, 1:]
        row, at = np.nonzero(pair)
        rank = self.merged(token[row, at], token[row, at + 1])
        tree[row, size + at] = np.where(rank < NONE, rank * size + at, NONE)
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        flat, token, after, before = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
        wide, tall = size + 1, 2 * size
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = flat[row * tall + 1]
            at, rank = root % size, root // size
            place = row * wide
            dead = after[place + at]
            behind, ahead = after[place + dead], before[place + at]
            token[place + at] = rank
            after[place + at] = behind
            before[place + behind] = at
            live[row, dead] = False
            here = self._leaf(token, place, at, behind, size)
            prior = self._leaf(token, place, ahead, at, size)
            node = np.concatenate([at, dead, np.where(ahead == size, at, ahead)]) + size
            value = np.concatenate([here, np.full(len(row), NONE), np.where(ahead == size, here, prior)])
            base = np.tile(row * tall, 3)
            flat[base + node] = value
            for _ in range(levels):
                node >>= 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])
            row = row[flat[row * tall + 1] < NONE]
        row, at = np.nonzero(live)
        ids = token[row * wide + at].tolist()
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def _leaf(self, token: np.ndarray, place: np.ndarray, at: np.ndarray, then: np.ndarray, size: int) -> np.ndarray:
        """A leaf's value for the pair at `at` and `then`; NONE where one of them is no byte."""
        rank = self.merged(token[place + at], token[place + then])
        return np.where((rank < NONE) & (at < size) & (then < size), rank * size + at, NONE)

    def merge_one(self, word: bytes) -> list[int]:
        """A word of any length on one tree."""
        n = len(word)
        token = self.byte[np.frombuffer(word, np.uint8)].tolist()
        size = 1 << max(1, (n - 1).bit_length())
        get, base = self.pairs.get, self.base
        tree = [NONE * size] * (2 * size)
        for k in range(n - 1):
            rank = get(token[k] * base + token[k + 1])
            if rank is not None:
                tree[size + k] = rank * size + k
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def put(place: int, left: int, right: int) -> None:
            rank = get(token[left] * base + token[right]) if left >= 0 and right >= 0 else None
            node = size + place
            tree[node] = NONE * size if rank is None else rank * size + place
            while node > 1:
                node >>= 1
                new = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == new:
                    return
                tree[node] = new

        while tree[1] < NONE * size:
            at, rank = tree[1] % size, tree[1] // size
            dead = after[at]
            token[at] = rank
            after[at] = after[dead]
            if after[at] >= 0:
                before[after[at]] = at
            put(dead, -1, -1)
            put(at, at, after[at])
            if before[at] >= 0:
                put(before[at], before[at], at)
        out, at = [], 0
        while at >= 0:
            out.append(token[at])
            at = after[at]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, starts = self.words.encode(texts)
        return [ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of known ids, one after another."""
        length = self.length[ids]
        done = np.cumsum(length)
        total = int(done[-1]) if len(done) else 0
        return self.blob[np.repeat(self.offset[ids] - (done - length), length) + np.arange(total)].tobytes()


def ranks(path: str) -> Ranks:
    """The file's tables, built once per Python worker."""
    cache = worker_cache("ranks")
    if path not in cache:
        cache[path] = Ranks(path)
    return cache[path]


def encode(text: Column, path: str) -> Column:
    """array<int> of ids."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        table, out = ranks(path), []
        for part in blocks(texts.to_frame("text"), "text"):
            out += [x.astype(np.int32) for x in table.encode([t if isinstance(t, str) else "" for t in part["text"]])]
        return pd.Series(out, dtype=object)

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that an array of ids stands for; NULL stays NULL."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        table = ranks(path)
        return pd.Series([None if x is None else table.decode(np.asarray(x, np.int64)) for x in rows], dtype=object)

    return run(ids)


def round_trip(text: Column, path: str) -> Column:
    """A struct of n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, without
    moving the ids between Python and Spark."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        table, rows = ranks(path), []
        name = table.decimal.__getitem__
        for part in blocks(texts.to_frame("text"), "text"):
            for ids in table.encode([t if isinstance(t, str) else "" for t in part["text"]]):
                listed = ",".join(map(name, ids.tolist())).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(table.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
