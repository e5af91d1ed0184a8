"""Byte-level BPE by ranks, encoding and decoding.

Merges of one pre-token run on a linked list of its parts. A queue of ranks holds the pairs that can
merge: a bucket of positions per rank, and a bitmap of two levels over the ranks in use, so the next
rank is found by find-first-set. Entries whose pair has changed since are skipped. The cost is near
linear in the length of the pre-token, so a text without any break is no special case.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirecheck.llm.shared import slices

#: Pre-tokens of a generation that a worker remembers, and the longest one it remembers, in characters.
REMEMBERED, LONGEST = 1 << 18, 48
#: Matches handled at once, and bytes of text in one output batch.
MATCHES, CHARACTERS = 1 << 16, 1 << 21
#: Bits of a word of the lower level of the bitmap; the upper level has a bit for each word.
STEP = 8
MASK = (1 << STEP) - 1
#: Rank of what is no pair.
NONE = 1 << 60


def read_ranks(path: str) -> list[bytes]:
    """The byte string of each id, from a file of ``base64 id`` lines; the file is read by the driver."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    words = [b""] * (1 + max(int(i) for _, i in pairs))
    for word, i in pairs:
        words[int(i)] = base64.b64decode(word)
    return words


class Remembered(dict):
    """Ids of pre-tokens, in two generations: what is asked for again survives, memory stays bounded."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.old = merge, {}

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.old.get(token)
        if ids is None:
            ids = tuple(self.merge(token.encode()))
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[token] = ids
        return ids


class Encoder:
    """Ids of texts; ``words`` gives the byte string of each id (empty: no such id)."""

    def __init__(self, words: list[bytes], pattern: str):
        self.ids = {w: i for i, w in enumerate(words) if w}
        self.longest = max(map(len, words), default=0)
        self.pattern = regex.compile(pattern)
        self.low = [0] * ((len(words) >> STEP) + 1)  # the lower level of the bitmap; all zero between merges
        self.pairs = [[self.ids.get(bytes((a, b)), NONE) for b in range(256)] for a in range(256)]
        self.remembered = Remembered(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue is written out in place, as calls would cost more than its steps.

        Only pairs that no neighbour comes before are queued: the lowest rank of all is always such a pair,
        and a merge can bring up four others, itself, its left neighbour and the pairs next to these two.
        """
        rank_of = self.ids.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n, longest, low, buckets, pairs = len(piece), self.longest, self.low, {}, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [pairs[x][y] for x, y in zip(piece, piece[1:])]  # of the pair that starts there
        ranks.append(NONE)
        fresh, left_rank = [], NONE
        for at, rank in enumerate(ranks):
            if rank < left_rank and rank <= (ranks[at + 1] if at + 1 < n else NONE):
                fresh.append((rank, at))
            left_rank = rank
        top = 0
        while True:
            for rank, at in fresh:  # into the queue; a bucket is a place or, of several, a heap
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = at
                    word = rank >> STEP
                    bits = low[word]
                    if not bits:
                        top |= 1 << word
                    low[word] = bits | 1 << (rank & MASK)
                elif held.__class__ is int:
                    buckets[rank] = [held, at] if held < at else [at, held]
                else:
                    heapq.heappush(held, at)
            if not top:
                break
            fresh = []
            # Out of the queue: first set bits give the lowest rank, its bucket the leftmost place.
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << STEP) + (bits & -bits).bit_length() - 1
            at = buckets[rank]
            if at.__class__ is not int and len(held := at) > 1:
                at = heapq.heappop(held)
            else:
                if at.__class__ is not int:
                    at = at[0]
                del buckets[rank]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    top &= top - 1
            if ranks[at] != rank:
                continue  # stale
            gone = after[at]
            old_gone, ranks[gone] = ranks[gone], NONE
            after[at] = middle = after[gone]
            new, middle_rank = NONE, NONE
            if middle < n:
                before[middle] = at
                middle_rank, end = ranks[middle], after[middle]
                if end - at <= longest:
                    new = rank_of(piece[at:end], NONE)
            ranks[at] = new
            left, new_left = before[at], NONE
            if left >= 0:
                old_left = ranks[left]
                if middle - left <= longest:
                    new_left = rank_of(piece[left:middle], NONE)
                ranks[left] = new_left
                far = before[left]
                far_rank = ranks[far] if far >= 0 else NONE
                if new_left <= new and new_left < far_rank:
                    fresh.append((new_left, left))
                if old_left < far_rank <= new_left and far_rank < NONE and (before[far] < 0 or far_rank < ranks[before[far]]):
                    fresh.append((far_rank, far))
            if new <= middle_rank and new < new_left:
                fresh.append((new, at))
            if old_gone <= middle_rank < new and middle_rank <= (ranks[after[middle]] if after[middle] < n else NONE):
                fresh.append((middle_rank, middle))
        out, at = [], 0
        while at < n:
            out.append(self.ids[piece[at : after[at]]])
            at = after[at]
        return out

    def _tokens(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHARACTERS:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while tokens := list(islice(matches, MATCHES)):
            yield tokens

    def encode(self, text: str) -> np.ndarray:
        of = self.remembered.__getitem__
        parts = [np.fromiter(chain.from_iterable(map(of, tokens)), np.int32) for tokens in self._tokens(text)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.int32)


#: The encoder of a worker process, which serves one task after the other.
_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(words: list[bytes], pattern: str, vocabulary: int) -> Encoder:
    key = (vocabulary, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(words, pattern)
    return _ENCODERS[key]


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    ids = [encoder.encode(t) for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def _decoded(words: list[bytes], lists: pa.ListArray) -> pa.Array:
    of, ids, at = words.__getitem__, lists.values.to_numpy().tolist(), lists.offsets.to_pylist()
    return pa.array([b"".join(map(of, ids[a:b])) if known else None for a, b, known in zip(at, at[1:], lists.is_valid().to_pylist())], pa.binary())


def _kept(df: DataFrame, *replaced: str) -> list[str]:
    return [c for c in df.columns if c not in replaced]


def encode(df: DataFrame, words: list[bytes], pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Replace the text by ``out_col``, the array of its ids; all other columns are carried.

    Each match of ``pattern`` is encoded by itself and no special tokens are known. A null text counts as
    empty; empty texts give an empty array. With ``decoded_col``, the ids are decoded again in the same pass,
    to the bytes they stand for. Columns that are called like a new one are replaced. The vocabulary is
    broadcast; its size is that of the tokenizer's file. Every single byte should be in it: a byte that is
    missing raises KeyError.
    """
    kept = _kept(df, text_col, out_col, *([decoded_col] if decoded_col else []))
    held = df.sparkSession.sparkContext.broadcast(words)
    vocabulary = zlib.crc32(b"\n".join(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value, pattern, vocabulary)
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(0)).to_pylist(), CHARACTERS):
                part = batch.slice(a, b - a)
                ids = _encoded(encoder, part.column(0))
                new = {out_col: ids} | ({decoded_col: _decoded(held.value, ids)} if decoded_col else {})
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new.values()], names=[*kept, *new])

    schema = df.select(*kept).schema.add(out_col, T.ArrayType(T.IntegerType()))
    if decoded_col:
        schema = schema.add(decoded_col, T.BinaryType())
    apart = "_" * (1 + max(map(len, df.columns)))  # no column has this name
    return df.select(F.coalesce(F.col(text_col), F.lit("")).alias(apart), *kept).mapInArrow(run, schema)


def decode(df: DataFrame, words: list[bytes], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the bytes that the ids stand for; all columns are carried.

    Null ids give null, an empty array empty bytes; an id that the vocabulary lacks raises an error. Bytes
    need not be valid UTF-8 when ids were not made by ``encode``. A column called like ``out_col`` is replaced.
    """
    kept = _kept(df, out_col)
    held = df.sparkSession.sparkContext.broadcast(words)
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [4 * (s or 0) for s in batch.column(at).value_lengths().to_pylist()]
            for a, b in slices(sizes, CHARACTERS):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(held.value, part.column(at))], names=[*kept, out_col])

    schema = df.select(*kept).schema.add(out_col, T.BinaryType())
    return df.select(*kept).mapInArrow(run, schema)
