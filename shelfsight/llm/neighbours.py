"""Most similar vectors for every vector.

Inverted lists with an adaptive dimension scan.  Every vector is stored in its
``probes`` nearest lists; vectors that share a list are compared.  Within a
list the vectors are rotated at random and scanned in blocks of columns: after
each block a hypothesis test on the partial distance abandons a candidate that
can hardly be within the radius, which is the list's radius or the distance of
the query's k-th best so far, whichever is smaller.  Survivors get the exact
cosine in double.

The list centres are fitted on a bounded sample (``SAMPLE_PER_LIST`` rows for
each of at most ``MAX_LISTS`` lists) by partial sums over its partitions; all
rows are assigned.  Beyond MAX_LISTS * ROWS_PER_LIST vectors the lists grow,
and are cut into more tiles.  Equal vectors
are merged before the shuffle: a class of copies keeps its ``k + 1`` smallest
ids, and each further copy refers to the last of these, whose list is the same
as its own.  Lists that the sample shows to be long are cut into square tiles,
so that one task compares at most two blocks of ``BLOCK`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.runtime import discard, materialise, spread

ROWS_PER_LIST = 1024
MAX_LISTS = 16384
SAMPLE_PER_LIST = 16
PROBES = 3
BLOCK = 6144
#: Stored rows (a vector in a list) for which there is a task.
ROWS_PER_TASK = 16_384
COLUMNS = 16
#: Significance of the test: larger abandons later.
EPSILON = 2.1
#: Row limit up to which the side of an existence test is broadcast (8 bytes a row).
BROADCAST_ROWS = 1_000_000
SCALE = 1_000_000


def finite_and_nonzero(value: Column) -> Column:
    """False for null, for any null, NaN or infinite element, and if all are zero."""
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(value.isNotNull() & ~bad & F.exists(value, lambda x: x != 0), F.lit(False))


def existing(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``; broadcast only up to BROADCAST_ROWS keys."""
    few = keys.count() <= BROADCAST_ROWS
    keys = keys.select(on).where(F.col(on).isNotNull()).distinct()
    return df.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), on, "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as float32 matrix."""
    n = len(column)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(n, -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def rotation(d: int) -> np.ndarray:
    """Random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _nearest(unit: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Indices of the ``probes`` nearest centres of each row, nearest first."""
    out = np.empty((len(unit), min(probes, len(centres))), np.int64)
    for lo in range(0, len(unit), 4096):
        s = unit[lo : lo + 4096] @ centres.T
        rows = np.arange(len(s))
        for p in range(out.shape[1]):
            out[lo : lo + 4096, p] = best = s.argmax(1)
            s[rows, best] = -np.inf
    return out


def _sums(centres, probes: int):
    """Rows (grp, list, n, total): how many of a partition's vectors have a list among their nearest, and their sum where ``probes`` is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            grp = np.array(b.column("grp").to_pylist(), object)
            for g in sorted(set(grp)):
                own = centres.value[g]
                unit = _unit(_matrix(b.column("value").take(pa.array(np.flatnonzero(grp == g))))).astype(np.float32)
                at = _nearest(unit, own, probes)
                counts[g] = counts.get(g, 0) + np.bincount(at.ravel(), minlength=len(own))
                if probes == 1:
                    np.add.at(total.setdefault(g, np.zeros_like(own)), at[:, 0], unit)
        for g, n in counts.items():
            some = np.flatnonzero(n)
            values = [total[g][i].tobytes() for i in some] if probes == 1 else [b""] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(some)), pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(values, pa.binary())], names=["grp", "list", "n", "total"])

    return run


def _added(t: pa.Table) -> pa.Table:
    values = [np.frombuffer(v, np.float32) for v in t["total"].to_pylist() if v]
    total = np.sum(values, axis=0, dtype=np.float32).tobytes() if values else b""
    return pa.table({"grp": t["grp"][:1], "list": t["list"][:1], "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "total": pa.array([total], pa.binary())})


def fit_lists(rows: DataFrame, n: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centres of each group of comparable vectors, and into how many blocks each list is cut.

    Both come from a sample of about SAMPLE_PER_LIST * MAX_LISTS rows at most,
    drawn by a hash of the id and written once.  The k-means steps run over
    its partitions, which give partial sums; the driver only holds the centres
    (at most about MAX_LISTS of them).
    """
    lists = min(MAX_LISTS, max(1, n // ROWS_PER_LIST))
    share = min(1.0, SAMPLE_PER_LIST * lists / max(1, n))
    if lists == 1:
        return {}
    spark = rows.sparkSession
    drawn = lambda salt: F.pmod(F.xxhash64("vector_id", F.lit(salt)), F.lit(1 << 30))
    sample = materialise(rows.where(drawn("centres") < int(share * (1 << 30))).select("grp", "value", (drawn("first") < (1 << 30) // SAMPLE_PER_LIST).alias("first")), "sample")
    got = sample.where("first").select("grp", "value").toArrow()
    grp, centres = np.array(got["grp"].to_pylist(), object), {}
    for g in sorted(set(grp)):
        centres[g] = _unit(_matrix(got["value"].combine_chunks().take(pa.array(np.flatnonzero(grp == g))))).astype(np.float32)
    # a group without a centre stays one list
    rest = sample.where(F.col("grp").isin(list(centres))).select("grp", "value")

    def summed(probes: int) -> list:
        part = rest.mapInArrow(_sums(spark.sparkContext.broadcast(centres), probes), "grp string, list int, n bigint, total binary")
        return part.groupBy("grp", "list").applyInArrow(_added, "grp string, list int, n bigint, total binary").collect()

    for _ in range(3):
        moved = {g: c.copy() for g, c in centres.items()}
        for r in summed(1):
            total = np.frombuffer(r["total"], np.float32)
            length = float(np.linalg.norm(total))
            if length > 1e-6:
                moved[r["grp"]][r["list"]] = total / length
        centres = moved
    blocks = {g: np.ones(len(c), np.int64) for g, c in centres.items()}
    for r in summed(PROBES):
        blocks[r["grp"]][r["list"]] = max(1, math.ceil(r["n"] / share / BLOCK))
    discard(sample)
    return {g: (c, blocks[g]) for g, c in centres.items()}


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _classes(m: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal vectors: (class, place within it by id) of each row in the order ``order``, and each class's first row."""
    _, first, at = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * 4)))[:, 0], return_index=True, return_inverse=True)
    order = np.lexsort((ids, at))
    own = at[order]
    start = np.searchsorted(own, np.arange(len(first)))
    return order, own, np.arange(len(own)) - start[own], first


def _assign(fitted, keep: int, probes: int, groups: int):
    """Rows of (grp, list, tile, block, home, ids, value); a surplus copy gives (null value, [id, its deputy])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = fitted.value
        for b in batches:
            grp = np.array(b.column("grp").to_pylist(), object)
            for g in sorted(set(grp)):
                part = b.take(pa.array(np.flatnonzero(grp == g)))
                m, ids = _matrix(part.column("value")), part.column("vector_id").to_numpy()
                order, own, place, first = _classes(m, ids)
                held = ids[order]
                deputy = np.full(len(first), -1, np.int64)
                deputy[own[place == keep - 1]] = held[place == keep - 1]
                spare = place >= keep
                names = _lists(np.bincount(own[~spare], minlength=len(first)), pa.array(held[~spare]))
                if g in lists:
                    centres, blocks = lists[g]
                    at = _nearest(_unit(m[first]).astype(np.float32), centres, probes)
                else:
                    at, blocks = np.zeros((len(first), 1), np.int64), np.ones(1, np.int64)
                odd = np.random.default_rng(3).integers(1, 1 << 62, m.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
                mixed = (np.ascontiguousarray(m[first]).view(np.uint32).astype(np.uint64) * odd).sum(1, dtype=np.uint64) >> np.uint64(32)
                row, where, tile, block, home = [], [], [], [], []
                for p in range(at.shape[1]):
                    x = at[:, p]
                    parts = blocks[x]
                    z = (mixed * parts.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                    for y in range(int(parts.max())):
                        some = np.flatnonzero(parts > y)
                        row.append(some)
                        where.append(x[some])
                        tile.append(np.minimum(z[some], y) * parts[some] + np.maximum(z[some], y))
                        block.append(z[some])
                        home.append((z[some] == y) & (p == 0))
                row, where, tile, block, home = (np.concatenate(c) for c in (row, where, tile, block, home))
                values = pa.array([v.tobytes() for v in m[first]], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * len(row)), pa.array(where.astype(np.int32)), pa.array(tile.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(home), names.take(take), values.take(take)],
                    names=["grp", "list", "tile", "block", "home", "ids", "value"],
                )
                n = int(spare.sum())
                if n:
                    pair = np.stack([held[spare], deputy[own[spare]]], 1).ravel()
                    zero = pa.array(np.zeros(n, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * n), pa.array((-1 - held[spare] % groups).astype(np.int32)), zero, zero, pa.array(np.ones(n, bool)), _lists(np.full(n, 2), pa.array(pair)), pa.nulls(n, pa.binary())],
                        names=["grp", "list", "tile", "block", "home", "ids", "value"],
                    )

    return run


def scan_list(query: np.ndarray, stored: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, stored rows, cosines) with rounded cosine >= least, by the adaptive dimension scan.

    ``query`` and ``stored`` are unit vectors in double.  Yields chunks of
    results; a query's radius shrinks to that of its k-th best as chunks pass.
    """
    d = query.shape[1]
    turn = rotation(d)
    q, x = (query @ turn).astype(np.float32), (stored @ turn).astype(np.float32)
    least -= 0.6 / SCALE
    radius = np.full(len(q), 2 - 2 * least)
    best = np.full((len(q), k), -1.0)
    for lo in range(0, len(x), 1024):
        y = x[lo : lo + 1024]
        for at in range(0, len(q), 1024):
            a, done = q[at : at + 1024], min(COLUMNS, d)
            allow = radius[at : at + 1024] * done / d * (1 + EPSILON / math.sqrt(done)) ** 2 if done < d else radius[at : at + 1024] + 1e-5
            near = a[:, :done] @ y[:, :done].T
            near -= ((a[:, :done] ** 2).sum(1) - allow.astype(np.float32))[:, None] / 2
            near -= (y[:, :done] ** 2).sum(1)[None] / 2
            i, j = np.nonzero(near >= 0)
            while len(i) and done < d:
                upto = min(done + COLUMNS, d)
                part = ((a[i, :upto] - y[j, :upto]) ** 2).sum(1)
                allow = radius[at + i] * upto / d * (1 + EPSILON / math.sqrt(upto)) ** 2 if upto < d else radius[at + i] + 1e-5
                stay = part <= allow
                i, j, done = i[stay], j[stay], upto
            if not len(i):
                continue
            cos = np.einsum("ij,ij->i", query[at + i], stored[lo + j])
            ok = cos >= least
            i, j, cos = i[ok], j[ok], cos[ok]
            if len(i):
                yield at + i, lo + j, cos
                order = np.lexsort((-cos, i))
                i, cos = i[order], cos[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                top = place < k
                new = np.full((len(a), k), -1.0)
                new[i[top], place[top]] = cos[top]
                both = -np.sort(-np.concatenate([best[at : at + 1024], new], axis=1), axis=1)[:, :k]
                best[at : at + 1024] = both
                # ties of the rounded value must stay in, hence the allowance
                radius[at : at + 1024] = np.minimum(radius[at : at + 1024], 2 - 2 * both[:, -1] + 2.0 / SCALE)


#: Pairs that a task holds before it keeps each vector's best only.
HELD = 1 << 21


def _best(a: np.ndarray, s: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (a, s, x), the ``most`` of each a that come first by (-s, x), in this order; equal (a, x) once."""
    order = np.lexsort((x, -s, a))
    a, s, x = a[order], s[order], x[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1])
    a, s, x = a[new], s[new], x[new]
    top = np.arange(len(a)) - np.searchsorted(a, a) < most
    return a[top], s[top], x[top]


def _expand(index: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``index`` its entries: (place in index, place of the entry)."""
    n = size[index]
    row = np.repeat(np.arange(len(index)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[index][row]


def _compare(k: int, least: float):
    keep = k + 1

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lone = t.filter(pa.compute.is_null(t["value"]))
        pair = lone["ids"].combine_chunks().flatten().to_numpy().reshape(-1, 2) if lone.num_rows else np.empty((0, 2), np.int64)
        deputies = [pair]
        t = t.filter(pa.compute.is_valid(t["value"]))
        out = [np.empty(0, np.int64)] * 3
        if t.num_rows:
            # classes of equal vectors, which may come from several batches: their ids, in order
            m = _matrix(t["value"].combine_chunks())
            sizes = pa.compute.list_value_length(t["ids"]).to_numpy()
            ids, row = t["ids"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(m)), sizes)
            order, own, place, first = _classes(m[row], ids)
            ids, row = ids[order], row[order]
            at = np.empty(len(m), np.int64)
            at[row] = own
            home = np.zeros(len(first), bool)
            np.logical_or.at(home, at, t["home"].to_numpy(zero_copy_only=False))
            deputy = np.full(len(first), -1, np.int64)
            deputy[own[place == keep - 1]] = ids[place == keep - 1]
            far = (place >= keep) & home[own]
            deputies.append(np.stack([ids[far], deputy[own[far]]], 1))
            near = place < keep
            ids, own = ids[near], own[near]
            start, size = np.searchsorted(own, np.arange(len(first))), np.bincount(own, minlength=len(first))
            some = np.empty(len(first), np.int64)
            some[at] = np.arange(len(m))
            unit = _unit(m[some])
            block = t["block"].to_numpy()
            sets = [np.unique(at[block == x]) for x in np.unique(block)]
            sides = [(sets[0], sets[0])] if len(sets) == 1 else [(sets[0], sets[1]), (sets[1], sets[0])]
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            number = 0
            for left, right in sides:
                for i, j, cos in scan_list(unit[left], unit[right], keep, least):
                    s = np.rint(cos * SCALE).astype(np.int64)
                    a, b = left[i], right[j]
                    ok = (s >= round(least * SCALE)) & (a != b)
                    a, b, s = a[ok], b[ok], s[ok]
                    which, entry = _expand(b, start, size)
                    held.append((a[which], s[which], ids[entry]))
                    number += len(which)
                    if number > HELD:
                        held = [_best(*(np.concatenate(c) for c in zip(*held, strict=True)), keep)]
                        number = len(held[0][0])
            held.append((own, np.full(len(own), SCALE), ids))
            a, s, x = _best(*(np.concatenate(c) for c in zip(*held, strict=True)), keep)
            # each id of a class takes the class's best but itself
            start, size = np.searchsorted(a, np.arange(len(first))), np.bincount(a, minlength=len(first))
            which, entry = _expand(own, start, size)
            other = x[entry] != ids[which]
            which, entry = which[other], entry[other]
            top = np.arange(len(which)) - np.searchsorted(which, which) < k
            out = [which[top], s[entry[top]], x[entry[top]]]
            names = ids
        which, s, x = out
        owner, size = np.unique(which, return_counts=True)
        pair = np.concatenate(deputies)
        near = _lists(size, pa.StructArray.from_arrays([pa.array((-s).astype(np.int32)), pa.array(x)], names=["s", "id"]))
        id_ = np.concatenate([names[owner], pair[:, 0]]) if len(owner) else pair[:, 0]
        n, o = len(pair), len(owner)
        return pa.table({
            "vector_id": pa.array(id_.astype(np.int64)),
            "near": pa.concat_arrays([near, pa.nulls(n, near.type)]),
            "deputy": pa.concat_arrays([pa.nulls(o, pa.int64()), pa.array(pair[:, 1].astype(np.int64))]),
        })

    return run


def nearest_lists(rows: DataFrame, k: int = 5, least: float = 0.9, probes: int = PROBES, about: int | None = None) -> DataFrame:
    """(vector_id, neighbour, similarity): each vector's up to k nearest comparable others.

    ``rows`` has vector_id bigint (unique), grp string (vectors are compared
    within it; one length per grp) and value array<float>; other columns are
    ignored.  Rows with null id or grp, or a value that is null, all zero or
    has a null or non-finite element give nothing.  Similarity is the cosine
    rounded to 6 decimals; ties go to the smaller id.  An empty table gives no
    row.  ``about`` is the number of rows, if it's known; it only sets the
    number of lists.
    """
    spark = rows.sparkSession
    rows = rows.select("vector_id", "grp", "value").where(F.col("vector_id").isNotNull() & F.col("grp").isNotNull() & finite_and_nonzero(F.col("value")))
    about = rows.count() if about is None else about
    fitted = spark.sparkContext.broadcast(fit_lists(rows, about))
    # surplus copies pass through in groups of some thousand
    groups = max(64, about // ROWS_PER_LIST)
    placed = spread(rows).mapInArrow(_assign(fitted, k + 1, probes, groups), "grp string, list int, tile int, block int, home boolean, ids array<bigint>, value binary")
    # by the list and tile, into as many tasks as the rows need
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), about * probes // ROWS_PER_TASK)
    placed = placed.repartition(tasks, "grp", "list", "tile")
    found = materialise(placed.groupBy("grp", "list", "tile").applyInArrow(_compare(k, least), "vector_id bigint, near array<struct<s:int,id:bigint>>, deputy bigint"), "near")
    # the k best of each vector, over the lists that it shares with others
    best = (
        found.where("near is not null").groupBy("vector_id").agg(F.flatten(F.collect_list("near")).alias("near"))
        .select("vector_id", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))
    )
    # a surplus copy takes the list of its deputy, which may be a surplus copy of the whole table
    named = found.where("deputy is not null").groupBy("vector_id").agg(F.max("deputy").alias("deputy"))
    again = named.select(F.col("vector_id").alias("deputy"), F.col("deputy").alias("chief"))
    named = named.join(again, "deputy", "left").select("vector_id", F.coalesce("chief", "deputy").alias("deputy"))
    lent = named.join(best.withColumnRenamed("vector_id", "deputy"), "deputy").select("vector_id", "near")
    near = best.join(named.select("vector_id"), "vector_id", "left_anti").unionByName(lent)
    return near.select("vector_id", F.explode("near").alias("n")).select("vector_id", F.col("n.id").alias("neighbour"), (-F.col("n.s") / F.lit(float(SCALE))).alias("similarity"))


def comparable_vectors(vectors: DataFrame, refs: DataFrame) -> DataFrame:
    """The valid rows of ``vectors`` as (vector_id, grp, value).

    Valid: the ref exists and the value is as long as ``dimension``;
    nearest_lists() leaves out values that aren't finite or all zero.  grp joins the trimmed lower-case model and view
    and the length; a null model or view forms no group.
    """
    model, view = (F.lower(F.trim(c)) for c in ("embedding_type", "crop_type"))
    good = vectors.where(F.size("value") == F.col("dimension")).select("vector_id", "ref_id", F.concat_ws("\x1f", model, view, "dimension").alias("grp"), "value", model.isNull().alias("a"), view.isNull().alias("b"))
    return existing(good.where(~F.col("a") & ~F.col("b")), refs, "ref_id").select("vector_id", "grp", "value")


def similar_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (vector_a < vector_b) of which at least one is in the other's list."""
    return lists.select(F.least("vector_id", "neighbour").alias("vector_a"), F.greatest("vector_id", "neighbour").alias("vector_b")).distinct()
