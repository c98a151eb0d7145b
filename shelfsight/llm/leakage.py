"""Evaluation texts leaking into training text.

Documents are joined to the held-out items by seeds: the word bigrams of an
item that fewest items have.  As a pair must have a number t of bigrams in
common, any t - 1 of an item's need not be seeds, and the commonest aren't.
A joined pair whose bigrams do not lie as near to one diagonal as those of an
alignment of the asked score must (or in a row, for the asked run) is left out;
every other pair is decided by a Smith-Waterman alignment, which gives its
score and its longest run of consecutive equal words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.runtime import spread

WORDS = re.compile(r"[^\W_]+")  # maximal runs of the categories L and N
RUN = 12
#: Words of an n-gram by which documents are joined to items, where the scores asked for allow it; else single words.
GRAM = 2
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, 2
#: Hits that are looked at together.
HITS = 1 << 20
#: Cells of a row of alignments that are computed together.
CELLS = 1 << 16
#: Items of one shard: bounds what is broadcast.
SHARD_ITEMS = 20_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _gram_keys(ids: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A 64-bit key of the n words at each position; 0 where one of them is unknown (0)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    key, known = np.zeros(len(ids) - n + 1, np.uint64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        known &= part > 0
    return np.where(known, np.maximum(key, 1), 0).astype(np.uint64)


def needed(length: int, least: float, gram: int) -> int:
    """n-grams of an item of ``length`` words that a text must hold for a score of ``least``.

    An alignment of m matches, a mismatches, b inserted words and c words left
    out scores 2m - a - 2b - 2c >= 2 * least * length with m + a + c <= length,
    so m >= least * length.  It has at most 1 + a + b + c runs of matches,
    hence at least m - 1 - a - b - c bigrams, which is least at
    m = length * (1 + 2 * least) / 3 with mismatches only.
    """
    if gram == 1:
        return max(1, math.ceil(least * length - 1e-9))
    return math.ceil(length * (4 * least - 1) / 3 - 1 - 1e-9)


class Items:
    """Held-out items as word ids, with the places of their n-grams."""

    def __init__(self, rows: list[tuple[int, str]], least: float, run: int = RUN):
        self.run, self.names, self.words = run, [], []
        self.vocabulary: dict[str, int] = {}
        for name, text in sorted(rows):
            words = words_of(text)
            if len(words) >= run:
                self.names.append(name)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        lengths = [len(w) for w in self.words]
        self.gram = GRAM if run >= GRAM and all(needed(n, least, GRAM) >= 1 for n in lengths) else 1
        self.need = np.array([needed(n, least, self.gram) for n in lengths], np.int64)
        #: How far the places of an alignment of the asked score can move along the text: the words put in and left out.
        self.band = np.array([int((1 - least) * n + 1e-9) for n in lengths], np.int64)
        self.size = np.array(lengths, np.int64)
        keys = [_gram_keys(w, self.gram) for w in self.words]
        every = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[order]
        self.place = np.concatenate([np.arange(len(k)) for k in keys])[order] if keys else order
        self.seed = self._rarest(np.repeat(np.arange(len(self.keys)), self.count))

    def _rarest(self, gram: np.ndarray) -> np.ndarray:
        """Which of the places hold a seed: all of an item's n-grams but the t - 1 places of those that most items have."""
        pair = np.unique(gram * max(1, len(self.names)) + self.item)
        items = np.bincount(pair // max(1, len(self.names)), minlength=len(self.keys))
        order = np.lexsort((gram, -items[gram], self.item))
        start = np.searchsorted(self.item[order], np.arange(len(self.names)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - start[self.item[order]]
        t = np.minimum(self.need, self.run - self.gram + 1)
        return rank >= t[self.item] - 1

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, n-gram) of the n-grams of items in a text."""
        own = _gram_keys(ids, self.gram)
        at = np.flatnonzero(own)
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        own = own[at]
        place = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ok = self.keys[place] == own
        return at[ok], place[ok]

    def places(self, at: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item, whether a seed), one for each place of each hit."""
        n = self.count[grams]
        row = np.repeat(self.first[grams] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[row], self.place[row], self.seed[row]


def _texts(b: pa.RecordBatch, vocabulary: dict[str, int]) -> Iterator[tuple[int, np.ndarray]]:
    get = vocabulary.get
    for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        if text and name is not None:
            yield name, np.fromiter((get(w, 0) for w in words_of(text)), np.int64)


def _align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """align() of the rows of two matrices; -1 fills up items and 0 texts, and equal nothing."""
    shape = (len(texts), texts.shape[1] + 1)
    above, best = np.zeros(shape, np.int32), np.zeros(len(texts), np.int32)
    runs, longest = np.zeros(shape, np.int32), np.zeros(len(texts), np.int32)
    slope = np.arange(shape[1], dtype=np.int32) * GAP
    for w in items.T:
        same = texts == w[:, None]
        row = np.zeros(shape, np.int32)
        row[:, 1:] = np.maximum(above[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), above[:, 1:] - GAP)
        np.maximum(row, 0, out=row)
        # a gap along the text: the best cell to the left less its distance
        row = np.maximum(row, np.maximum.accumulate(row + slope, axis=1) - slope)
        above, best = row, np.maximum(best, row.max(1))
        runs[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
        longest = np.maximum(longest, runs.max(1))
    return best, longest


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(scores, runs) of pairs (item, text) of word ids (0 equals nothing).

    The score is the best Smith-Waterman one, the run the longest of equal
    words.  Pairs with texts of about one length are aligned together.
    """
    scores, runs = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    while order:
        width = len(pairs[order[-1]][1])
        n = max(1, min(len(order), CELLS // max(1, width)))
        some, order = order[-n:], order[:-n]
        items = np.full((n, max(len(pairs[i][0]) for i in some)), -1, np.int32)
        texts = np.zeros((n, max(1, width)), np.int32)
        for k, i in enumerate(some):
            items[k, : len(pairs[i][0])] = pairs[i][0]
            texts[k, : len(pairs[i][1])] = pairs[i][1]
        scores[some], runs[some] = _align(items, texts)
    return scores, runs


def _candidates(texts: list[np.ndarray], own: list[tuple[np.ndarray, np.ndarray]], items: Items) -> Iterator[tuple[int, int, bool, list[tuple[int, int]]]]:
    """(text, item, whether there's a run, parts of the text to align) of the pairs that may reach the score or the run; own: hits() of the texts."""
    at, item, place, seed = items.places(np.concatenate([x for x, _ in own]), np.concatenate([g for _, g in own]))
    text = np.repeat(np.arange(len(texts)), [int(items.count[g].sum()) for _, g in own])
    pair = text * max(1, len(items.names)) + item
    joined = np.zeros(len(texts) * max(1, len(items.names)), bool)
    joined[pair[seed]] = True
    some = joined[pair]
    pair, at, item, place = pair[some], at[some], item[some], place[some]
    if not len(pair):
        return
    order = np.lexsort((at, at - place, pair))
    pair, at, item, shift = pair[order], at[order], item[order], (at - place)[order]

    def reach(more: np.ndarray | int) -> np.ndarray:
        """The hit that is ``more`` further on in the same pair, else -1."""
        to = np.arange(len(pair)) + more
        inside = to < len(pair)
        to = np.where(inside, to, 0)
        return np.where(inside & (pair[to] == pair), to, -1)

    row = reach(items.run - items.gram)
    runs = np.flatnonzero((row >= 0) & (shift[row] == shift) & (at[row] - at == items.run - items.gram))
    near = reach(items.need[item] - 1)
    dense = np.flatnonzero((near >= 0) & (shift[near] - shift <= items.band[item]))
    whole = set(np.unique(pair[runs]).tolist())
    for p in sorted(whole):
        yield p // len(items.names), p % len(items.names), True, [(0, len(texts[p // len(items.names)]))]
    parts: dict[int, list[tuple[int, int]]] = {}
    for p, i, s in zip(pair[dense].tolist(), item[dense].tolist(), shift[dense].tolist(), strict=True):
        if p in whole:
            continue
        lo, hi = max(0, s), s + int(items.band[i] + items.size[i]) + 1
        own_parts = parts.setdefault(p, [])
        if own_parts and lo <= own_parts[-1][1]:
            own_parts[-1] = (own_parts[-1][0], max(hi, own_parts[-1][1]))
        else:
            own_parts.append((lo, hi))
    for p, ranges in parts.items():
        yield p // len(items.names), p % len(items.names), False, ranges


def _score(shared, least: float):
    def scored(names: list[int], texts: list[np.ndarray], own: list[tuple[np.ndarray, np.ndarray]], items: Items) -> Iterator[tuple[int, int, int, float]]:
        found = list(_candidates(texts, own, items))
        parts = [(n, lo, hi) for n, (_, _, run, ranges) in enumerate(found) if not run for lo, hi in ranges]
        score, _ = align([(items.words[found[n][1]], texts[found[n][0]][lo:hi]) for n, lo, hi in parts])
        enough = {n for n, (_, _, run, _) in enumerate(found) if run} | {n for (n, _, _), x in zip(parts, score.tolist(), strict=True) if x >= least * MATCH * len(items.words[found[n][1]])}
        # a pair that some part decides is aligned as a whole, for its score and longest run
        last = [found[n][:2] for n in sorted(enough)]
        for (t, item), x, longest in zip(last, *(c.tolist() for c in align([(items.words[i], texts[t]) for t, i in last])), strict=True):
            most = MATCH * len(items.words[item])
            if longest >= items.run or x >= least * most:
                yield names[t], items.names[item], longest, x / most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            rows: list[tuple[int, int, int, float]] = []
            names: list[int] = []
            texts: list[np.ndarray] = []
            own: list[tuple[np.ndarray, np.ndarray]] = []
            hits = 0
            for name, ids in _texts(b, items.vocabulary):
                names.append(name)
                texts.append(ids)
                own.append(items.hits(ids))
                hits += int(items.count[own[-1][1]].sum()) + len(items.names)
                if hits >= HITS:
                    rows += scored(names, texts, own, items)
                    names, texts, own, hits = [], [], [], 0
            if texts:
                rows += scored(names, texts, own, items)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], names=["doc_id", "item_id", "run", "score"])

    return run


def leaks(documents: DataFrame, passages: DataFrame, least: float = 0.5, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, run, score): documents that hold items, whole, in part or edited.

    ``documents``: doc_id bigint, text; ``passages``: item_id bigint, text.
    run is the longest common run of consecutive words of a pair, score the
    best alignment's share of the item's best.  All pairs are returned whose
    run is ``run`` words or more, or whose score is ``least`` or more
    (``least`` above 0).  Null or empty texts and items of fewer than ``run``
    words give nothing, as do null ids; repeated rows give their pairs once;
    extra columns do not matter.

    Items go in shards of SHARD_ITEMS, each broadcast; the documents are
    scanned once for each, and are moved only where their files give fewer
    tasks than there are cores.
    """
    context = documents.sparkSession.sparkContext
    texts = spread(documents.select("doc_id", "text"))
    items = passages.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    shards, out = max(1, -(-items.count() // SHARD_ITEMS)), None
    for s in range(shards):
        shard = Items([(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).collect()], least, run)
        found = texts.mapInArrow(_score(context.broadcast(shard), least), "doc_id bigint, item_id bigint, run int, score double")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("score").alias("score"))
