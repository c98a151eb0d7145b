"""Long exact spans shared between records.

Sentences need not begin or end where a shared stretch does, so sentence runs
alone cannot give it to the character.  The spans here are cut by content
instead: from every stretch of ``span`` characters the lowest hash of its
``SEED``-character pieces is taken, which equal stretches have in common, and
pieces that occur in one text only are dropped after a global aggregation.
Only the stretches around pieces of several texts are then hashed at every
position and joined globally; what they cover are the shared positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.runtime import materialise, spread

SPAN = 240
SEED = 120
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def rolling(points: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of the ``width`` code points at each position (empty if there are fewer)."""
    n = len(points)
    if n < width:
        return np.empty(0, np.uint64)
    powers = np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, base, np.uint64), out=powers[1:])
    back = np.ones(n - width + 1, np.uint64)
    np.cumprod(np.full(n - width, pow(base, -1, 1 << 64), np.uint64), out=back[1:])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(base & 0xFFFF)) * powers[:n], out=total[1:])
    return _mixed((total[width:] - total[:-width]) * back)


def _over(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of the ``width`` values at each position, by doubling."""
    have = 1
    while have * 2 <= width:
        values, have = best(values[:-have], values[have:]), have * 2
    rest = width - have
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def seeds(points: np.ndarray, span: int = SPAN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the pieces that are the lowest of some stretch of ``span`` characters."""
    h = rolling(points, seed)
    width = span - seed + 1
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lowest = _over(h, width, np.minimum)
    # the largest of the minima of all stretches that hold a piece equals its hash if it is one of them
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_over(np.concatenate([edge, lowest, edge]), width, np.maximum) == h)
    return at, h[at]


def _seed_rows(span: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            piece, text_key, doc, pos = [], [], [], []
            for d, t, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, h = seeds(code_points(t), span, seed)
                piece.append(h)
                pos.append(at)
                doc.append(np.full(len(at), d))
                text_key.append(np.full(len(at), key))
            if piece:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(piece).view(np.int64)), pa.array(np.concatenate(text_key).astype(np.int64)), pa.array(np.concatenate(doc).astype(np.int64)), pa.array(np.concatenate(pos).astype(np.int32))], names=["piece", "text_key", "doc_id", "pos"])

    return run


def _span_rows(span: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "places")), strict=True):
                points = code_points(t)
                last = len(points) - span
                mark = np.zeros(last + 2, np.int64)
                at = np.array(places)
                np.add.at(mark, np.maximum(0, at + seed - span), 1)
                np.add.at(mark, np.minimum(last, at) + 1, -1)
                start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                a, c = (rolling(points, span, base)[start].view(np.int64) for base in BASES)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(np.full(len(start), d)), pa.array(start.astype(np.int32))], names=["a", "c", "doc_id", "start"])

    return run


def _merge_sorted(span: int):
    """Intervals of rows (doc_id, start) that come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = lo = hi = None

        def batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["doc_id", "start_pos", "end_pos"])

        for b in batches:
            d, s = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            if not len(d):
                continue
            rows = []
            # a new interval begins at another document or beyond the last one's end
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + span)]))
            ends = np.concatenate([cut[1:] - 1, [len(d) - 1]])
            for x, y, z in zip(d[cut].tolist(), s[cut].tolist(), (s[ends] + span).tolist(), strict=True):
                if doc == x and y <= hi:
                    hi = z
                else:
                    if doc is not None:
                        rows.append((doc, lo, hi))
                    doc, lo, hi = x, y, z
            if rows:
                yield batch(rows)
        if doc is not None:
            yield batch([(doc, lo, hi)])

    return run


def shared_spans(documents: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """(doc_id, start_pos, end_pos): the maximal runs of shared positions.

    A position is shared if it lies in a substring of ``span`` code points
    that also occurs, character for character, in the text of another doc_id
    (unique); positions count code points from 0 and the end is exclusive.
    Null ids, null texts and texts shorter than ``span`` give nothing.  Of
    equal texts all are shared wholly, and only the first takes part in the
    search.  Equal spans and equal texts are recognised by 128-bit hashes.  An empty table
    gives no row, extra columns do not matter.
    """
    long = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= span)).select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.unhex(F.md5("text")).alias("digest"), F.length("text").alias("n"))
    pieces = materialise(spread(long.select("doc_id", "text", "text_key")).mapInArrow(_seed_rows(span, seed), "piece bigint, text_key bigint, doc_id bigint, pos int"), "pieces")
    copies = materialise(long.groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "copies")
    several = pieces.groupBy("piece").agg(F.min("text_key").alias("x"), F.max("text_key").alias("y")).where("x <> y").select("piece")
    places = pieces.join(several, "piece", "left_semi").join(copies.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    rows = materialise(long.select("doc_id", "text").join(places, "doc_id").mapInArrow(_span_rows(span, seed), "a bigint, c bigint, doc_id bigint, start int"), "spans")
    common = rows.groupBy("a", "c").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("a", "c")
    starts = rows.join(common, ["a", "c"], "left_semi").select("doc_id", "start")
    single = copies.where("copies = 1").select("doc_id")
    parts = starts.repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_merge_sorted(span), "doc_id bigint, start_pos int, end_pos int").join(single, "doc_id", "left_semi")
    whole = long.select("doc_id", "digest", "n").join(copies.where("copies > 1").select("digest", "n"), ["digest", "n"], "left_semi")
    return parts.unionByName(whole.select("doc_id", F.lit(0).alias("start_pos"), F.col("n").cast("int").alias("end_pos")))


def shared_share(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared, share) of every document; share is null for null and empty texts."""
    n = F.coalesce(F.length("text"), F.lit(0))
    total = spans.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"))
    shared = F.coalesce("shared", F.lit(0))
    return documents.select("doc_id", n.alias("n_chars")).join(total, "doc_id", "left").select("doc_id", "n_chars", shared.cast("bigint").alias("shared"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).alias("share"))
