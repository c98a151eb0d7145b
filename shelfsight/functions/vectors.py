"""Vector expressions on array columns, all in the JVM.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column) -> Column:
    """Sum of an array's elements, 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double; null if an element or the lengths don't match."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def is_valid(a: Column | str) -> Column:
    """Not null, not empty, all finite, not all zero."""
    a = _col(a)
    wrong = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(a) > 0) & ~wrong & F.exists(a, lambda x: x != 0), F.lit(False))


def _unit_batch(a: pa.Array) -> pa.Array:
    n = np.nan_to_num(a.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null elements become NaN
    ok = n > 0
    if len(x):
        starts = (np.cumsum(n) - n)[ok]
        square = np.add.reduceat(x * x, starts)
        good = np.isfinite(square) & (square > 0)
        ok[ok] = good
        x = (x / np.repeat(np.sqrt(np.where(good, square, 1.0)), n[n > 0]))[np.repeat(ok, n)]
    offsets = np.concatenate([[0], np.cumsum(np.where(ok, n, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, pa.float64()), mask=pa.array(~ok))


def normalize(a: Column | str) -> Column:
    """Unit vector as array<double>, Arrow-batched; null where the vector is not valid."""
    return F.arrow_udf(_unit_batch, "array<double>")(_col(a).cast("array<double>"))


def clip(x: Column) -> Column:
    """Within [-1, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Clipped cosine; null where one of the vectors is not valid."""
    return clip(F.when(is_valid(a) & is_valid(b), dot(a, b) / (norm(a) * norm(b))))


def padded_cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine where the right vector is cut or zero-padded to the left's length; 0 where a norm is 0."""
    left, right = _col(left), _col(right)
    at = F.sequence(F.lit(0), F.size(left) - 1)
    other = F.when(F.size(left) > 0, F.transform(at, lambda i: F.coalesce(F.get(right, i).cast("double"), F.lit(0.0))))
    size = norm(left) * norm(other)
    return F.when(left.isNull() | right.isNull(), None).when(F.coalesce(size, F.lit(0.0)) == 0, 0.0).otherwise(dot(left, other) / size)


def best_matches(a: Column | str, b: Column | str) -> Column:
    """For each vector of ``a`` its largest inner product with one of ``b`` (arrays of vectors)."""
    return F.transform(_col(a), lambda x: F.array_max(F.transform(_col(b), lambda y: dot(x, y))))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def symmetric_best(a: Column | str, b: Column | str) -> Column:
    """Mean of the best matches both ways: the local score of two sets of views."""
    return clip((mean(best_matches(a, b)) + mean(best_matches(b, a))) / 2)


def aggregate(values: Column, how: str, top_k: int = 8, trim: float = 0.1) -> Column:
    """mean, median, trimmed_mean (int(trim * n) off each end) or top_k of an array of doubles."""
    n = F.size(values)
    ascending = F.array_sort(values)
    if how == "mean":
        return mean(values)
    if how == "median":
        return (F.get(ascending, F.floor((n - 1) / 2).cast("int")) + F.get(ascending, F.floor(n / 2).cast("int"))) / 2
    if how == "trimmed_mean":
        cut = F.floor(F.lit(trim) * n).cast("int")
        return mean(F.slice(ascending, cut + 1, n - 2 * cut))
    if how == "top_k":
        return mean(F.slice(F.sort_array(values, asc=False), F.lit(1), F.least(F.lit(top_k), n)))
    raise ValueError(f"unknown aggregation {how}")


def _matrices(c: pa.ListArray) -> list[np.ndarray | None]:
    """A matrix for each row of a list of lists of one length; None for null, empty and ragged ones."""
    inner = c.values
    values = inner.values.to_numpy(zero_copy_only=False).astype(np.float64)
    outer, at, null = c.offsets.to_numpy(), inner.offsets.to_numpy(), c.is_null().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for i in range(len(c)):
        edges = at[outer[i] : outer[i + 1] + 1]
        width = np.diff(edges)
        ok = not null[i] and len(width) and (width == width[0]).all() and width[0]
        out.append(values[edges[0] : edges[-1]].reshape(len(width), -1) if ok else None)
    return out


def _collapse(values: np.ndarray, how: str, k: int, trim: float) -> float:
    ascending = np.sort(values)
    if how == "median":
        return float(np.median(ascending))
    if how == "trimmed_mean":
        cut = int(trim * len(values))
        ascending = ascending[cut : len(values) - cut]
    elif how == "top_k":
        ascending = ascending[-k:]
    return float(ascending.mean())


def _best_match(how: str, top_k: int, trim: float, least: int):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out: list[float | None] = []
        for x, y in zip(_matrices(a), _matrices(b), strict=True):
            if x is None or y is None or min(len(x), len(y)) < least or x.shape[1] != y.shape[1]:
                out.append(None)
                continue
            s, k = x @ y.T, min(top_k, len(x), len(y))
            out.append(min(1.0, max(-1.0, (_collapse(s.max(1), how, k, trim) + _collapse(s.max(0), how, k, trim)) / 2)))
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")


def patch_similarity(a: Column | str, b: Column | str, how: str = "mean", top_k: int = 8, trim: float = 0.1) -> Column:
    """Symmetric similarity of two patch matrices, Arrow-batched; null with fewer than four patches on a side."""
    if how not in ("mean", "median", "trimmed_mean", "top_k"):
        raise ValueError(f"unknown aggregation {how}")
    kind = "array<array<double>>"
    return _best_match(how, top_k, trim, 4)(_col(a).cast(kind), _col(b).cast(kind))


def view_similarity(a: Column | str, b: Column | str) -> Column:
    """symmetric_best() of two sets of views, Arrow-batched; null if a set is empty."""
    kind = "array<array<double>>"
    return _best_match("mean", 1, 0.0, 1)(_col(a).cast(kind), _col(b).cast(kind))


def _dot_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    n = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64) for x in (a, b)]
    at = np.flatnonzero((n[0] == n[1]) & (n[0] > 0))  # null lengths are NaN
    out = np.full(len(a), np.nan)
    if len(at):
        x, y = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False) for c in (a, b))
        starts = np.concatenate([[0], np.cumsum(n[0][at])[:-1]]).astype(np.int64)
        out[at] = np.add.reduceat(x * y, starts)
    return pa.array(out, mask=np.isnan(out))


def dots(a: Column | str, b: Column | str) -> Column:
    """dot() of many rows, Arrow-batched: array lambdas are interpreted, so this is the faster one on long vectors."""
    return F.arrow_udf(_dot_batch, "double")(_col(a).cast("array<double>"), _col(b).cast("array<double>"))


def masked(patches: Column | str, mask: Column | str) -> Column:
    """The patches whose mask is true."""
    both = F.arrays_zip(_col(patches).alias("p"), _col(mask).alias("m"))
    return F.transform(F.filter(both, lambda x: x["m"]), lambda x: x["p"])


def even_sample(a: Column | str, limit: int) -> Column:
    """At most ``limit`` elements on an even grid from the first to the last."""
    a = _col(a)
    n = F.size(a)
    at = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(1, limit - 1))).cast("int"))
    return F.when(n <= limit, a).otherwise(F.transform(at, lambda i: F.get(a, i)))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are not null, weights scaled to these; null if no weight is left."""
    if not parts:
        return F.lit(None).cast("double")
    weight = reduce(lambda x, y: x + y, [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts])
    value = reduce(lambda x, y: x + y, [F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in parts])
    return F.when(weight > 0, value / weight)


def parse_vector(text: Column | str) -> Column:
    """``[a,b,...]`` to array<double>; null if it is not such a list."""
    return F.from_json(_col(text), "array<double>")


def format_vector(a: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_col(a), lambda x: x.cast("string")), ","), F.lit("]"))
