"""Packing token sequences into windows of a fixed size, best-fit decreasing.

A document becomes its token ids plus one closing id; an overlong one is first cut into full
windows. The rests are packed per shard (about SHARD_PIECES pieces, dealt by a hash, so a frequent
id does not fill one shard): longest first, each into the open window with the least room that
still fits. A segment tree over room 0..window finds that window; each shard leaves about one
window unfilled.

NULL and empty texts are the closing id alone. Equal rows are packed once each. Ties in length go
by doc_id (NULL last), then start, then checksum, so a rerun packs alike.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import blocks, bounded_batches, worker_cache
from shelfwise.llm.words import WordTable, listed
from shelfwise.sources.scratch import stage

WINDOW = 2048
CLOSING_ID = 1
SHARD_PIECES = 50_000
# Characters outside Latin, and the punctuation dashes and quotes, may be classed in two ways.
UNSURE = re.compile("[^\\x00-\u024f\u2010-\u2027]")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq long"


class TextIds:
    """Token ids of whole texts, remembered per word: the vocabulary splits a text into words, and a
    word has the same ids alone. Texts that hold an added token, or characters on which two Unicode
    versions could differ, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a token of a byte-level vocabulary has one character for each byte
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.token_bytes[k] = len(token)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = WordTable(self._words)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of single words. Words that begin with a space are encoded as one text: it
        splits into the same words, and the tokens' bytes tell where each ends."""
        joins = np.fromiter((w[0] == " " and len(w) > 1 and not w[1].isspace() for w in words), bool, len(words))
        made = [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for nth, encode in ((np.flatnonzero(joins), self._joined), (np.flatnonzero(~joins), self._single)):
            own = [words[k] for k in nth.tolist()]
            made += [encode(own[first : first + 4_000]) for first in range(0, len(own), 4_000)]
        size, flat = (np.concatenate(x) for x in zip(*made, strict=True))
        # back from joined words first to the order they came in
        order = np.argsort(np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)]))
        offset, size = (np.cumsum(size) - size)[order], size[order]
        done = np.cumsum(size)
        return size, flat[np.repeat(offset - (done - size), size) + np.arange(len(flat))]

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return listed([x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        sizes = map(len, words) if text.isascii() else (len(w.encode()) for w in words)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(words)))
        bytes_done = np.cumsum(self.token_bytes[ids])
        cut = np.searchsorted(bytes_done, ends)
        if cut[-1] + 1 != len(ids) or (bytes_done[cut] != ends).any():
            return self._single(words)  # a token reaches over a word's end
        return np.diff(cut, prepend=-1), ids

    def _whole(self, text: str) -> bool:
        return UNSURE.search(text) is not None or any(a in text for a in self.added)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        whole = [self._whole(t) for t in texts]
        ids, starts = self.words.encode(["" if w else t for t, w in zip(texts, whole, strict=True)])
        out = [ids[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        for k in np.flatnonzero(whole):
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint32)
        return out


def _encoder(path: str) -> TextIds:
    cache = worker_cache("text_ids")
    if path not in cache:
        cache[path] = TextIds(path)
    return cache[path]


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per piece of (doc_id, text). seq numbers the rows of a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seq = _encoder(vocabulary), 0
        for frame in frames:
            for part in blocks(frame, "text"):
                rows = []
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                for doc_id, ids in zip(part["doc_id"], encoder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
                    for start in range(0, len(ids), window):
                        own = ids[start : start + window]
                        rows.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids), seq))
                        seq += 1
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq"])

    bounded_batches(docs.sparkSession)
    # ids travel as text: a NULL among 64-bit numbers would turn them into floats
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text"))
    made = rows.mapInPandas(run, PIECES.replace("doc_id long", "doc_id string"))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


class RoomTree:
    """Segment tree over room 0..window: which rooms have an open window. find(n) gives the least
    room of at least n that is taken, or -1."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _set(self, room: int, value: int) -> None:
        node = room + self.size
        self.any[node] = value
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def add(self, room: int, window_id: int) -> None:
        self.open[room].append(window_id)
        if len(self.open[room]) == 1:
            self._set(room, 1)

    def take(self, room: int) -> int:
        window_id = self.open[room].pop()
        if not self.open[room]:
            self._set(room, 0)
        return window_id

    def find(self, need: int) -> int:
        node = need + self.size
        if self.any[node]:
            return need
        while node > 1:  # climb until a right neighbour holds something, then go down its left edge
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for lengths in decreasing order, each 1..window."""
    tree = RoomTree(window)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows = 0
    for k, length in enumerate(lengths.tolist()):
        room = tree.find(length)
        if room < 0:
            number, room = windows, window
            windows += 1
        else:
            number = tree.take(room)
        where[k], offset[k] = number, window - room
        if room > length:
            tree.add(room - length, number)
    return where, offset


def pack(made: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces with sequence_id and offset. Sequence ids are unique: shard * 2^32 + number."""
    shards = max(1, -(-made.count() // shard_pieces))
    dealt = made.withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "seq"), F.lit(shards)).cast("int")
    ).withColumn("doc_id", F.col("doc_id").cast("string"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = pd.to_numeric(frame["doc_id"]) if frame["doc_id"].isna().any() else frame["doc_id"].astype("int64")
        order = (
            frame.assign(number=number, size=-frame["length"])
            .sort_values(["size", "number", "start", "ids_crc32"], kind="stable", na_position="last")
            .drop(columns=["number", "size", "seq"])
        )
        where, offset = best_fit(order["length"].to_numpy(), window)
        return order.assign(sequence_id=where + (order["shard"].astype("int64").to_numpy() << 32), offset=offset).drop(columns="shard")

    packed = dealt.groupBy("shard").applyInPandas(
        run,
        "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Texts to packed pieces. The pieces are written once: they are counted, then packed."""
    return pack(stage(pieces(docs, vocabulary, window), "pieces"), window)
