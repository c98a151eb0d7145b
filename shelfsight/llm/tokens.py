"""Encoding of texts with a public byte-pair vocabulary.

The merges run on a hierarchical-bitmap rank queue: each merge rank has a
bucket of linked-list positions, bitmaps on three levels tell which buckets
hold any, find-first-set gives the lowest rank, and entries that a merge has
made stale are skipped when they come up.  A pre-token of n bytes takes
O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value of the public vocabulary: how texts are split before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker keeps the ids of so many distinct pre-tokens of at most so many characters.
KEPT, KEPT_LENGTH = 500_000, 48


class RankQueue:
    """Positions by rank, lowest rank first and lowest position within it."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int] | None:
        """(rank, position), or None if empty."""
        if not self.top:
            return None
        first = lambda word: (word & -word).bit_length() - 1
        a = first(self.top)
        b = a << 6 | first(self.middle[a])
        rank = b << 6 | first(self.low[b])
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] &= ~(1 << (rank & 63))
            if not self.low[b]:
                self.middle[a] &= ~(1 << (b & 63))
                if not self.middle[a]:
                    self.top &= ~(1 << a)
        return rank, position


class Encoder:
    """Texts to ids by a rank file; nothing in a text is special."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.find = regex.compile(PATTERN).findall
        kept = self

        class Cache(dict):
            def __missing__(self, piece: str) -> list[int]:
                ids = kept.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= KEPT_LENGTH:
                    if len(self) >= KEPT:
                        self.clear()
                    self[piece] = ids
                return ids

        self.cache = Cache()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank first, the leftmost of equal ones."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int] = [-1] * n  # rank of the pair that begins here; -1: none
        queue = self.queue

        def renew(i: int) -> None:
            j = after[i]
            pair[i] = -1
            if j < n and after[j] - i <= self.longest:
                rank = ranks.get(piece[i : after[j]])
                if rank is not None:
                    pair[i] = rank
                    queue.push(rank, i)

        for i in range(n - 1):
            renew(i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            j = after[i]
            after[i] = end = after[j]
            pair[j] = -1
            if end < n:
                before[end] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.find(text))))


_ENCODERS: dict[int, Encoder] = {}


def _encode(rank_file) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: bytes = rank_file.value
        encoder = _ENCODERS.get(hash(data)) or _ENCODERS.setdefault(hash(data), Encoder(data))
        for b in batches:
            for lo in range(0, len(b), 512):  # a few hundred texts at a time
                part = b.slice(lo, 512)
                ids = [np.array(encoder.encode(t), np.int32) if t else np.empty(0, np.int32) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[b.schema.names[0], "ids"])

    return run


def encode_texts(df: DataFrame, record: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(record, ids array<int>): each row's text as token ids.

    Null and empty texts give an empty list, a null id stays, repeated rows
    stay, other columns are dropped, an empty table gives no row.  Strings
    that look like special tokens are plain text.  The vocabulary file is read
    by the driver alone and broadcast (under 1 MB).
    """
    with open(vocabulary, "rb") as f:
        rank_file = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[record].dataType.simpleString()
    return spread(df.select(record, F.col(text))).mapInArrow(_encode(rank_file), f"`{record}` {kind}, ids array<int>")
