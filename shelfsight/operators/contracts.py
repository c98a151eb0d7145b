"""Rows and payloads against what a receiver accepts: quality gates, projections, budgets, codecs, set checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.runtime import materialise

# Fixed values of the gate, and of what payloads may hold.
LEAST_BLUR, LEAST_SIDE, LEAST_PIXELS, LEAST_STD = 60.0, 128, 16384, 8.0
MOST_BYTES, MOST_SCORE = 32768, 1.000001
SKU_BYTES, IMAGE_BYTES = 255, 512
FORBIDDEN = "(?i)embedding|vector"
MOST_PROPOSALS = 5


def quality_reasons(blur: Column, min_side: Column, crop_pixels: Column, gray_std: Column, least: tuple[float, int, int, float] = (LEAST_BLUR, LEAST_SIDE, LEAST_PIXELS, LEAST_STD)) -> Column:
    """array<string> of why a photo is not fit as a reference, empty if it is.

    Blur and side must be there (and blur finite); pixels and deviation count
    only where they are.
    """
    finite = blur.isNotNull() & ~F.isnan(blur) & (F.abs(blur) < float("inf"))
    found = (
        F.when(~F.coalesce(finite, F.lit(False)), "missing_blur").when(blur < least[0], "low_blur"),
        F.when(min_side.isNull(), "missing_size").when(min_side < least[1], "too_small"),
        F.when(crop_pixels < least[2], "object_too_small"),
        F.when(gray_std < least[3], "near_blank"),
    )
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def present(fields: Column, keys: tuple[str, ...]) -> Column:
    """Of a map those keys that are asked for; null stays null."""
    return F.map_filter(fields, lambda k, _: k.isin(*keys))


def forbidden(fields: Column) -> Column:
    """Whether a key of a map speaks of an embedding or a vector; false for null."""
    return F.coalesce(F.exists(F.map_keys(fields), lambda k: k.rlike(FORBIDDEN)), F.lit(False))


def within_budget(text: Column, most: int = MOST_BYTES) -> Column:
    """Whether a text has ``most`` bytes in UTF-8 or fewer; true for null."""
    return F.coalesce(F.octet_length(text) <= most, F.lit(True))


def valid_score(x: Column) -> Column:
    """Null, or finite and within [-1, 1] by a tolerance."""
    return x.isNull() | (~F.isnan(x) & (F.abs(x) <= MOST_SCORE))


def candidate(rank: Column, place: Column, sku: Column, image_id: Column, scores: list[Column]) -> Column:
    """struct<valid, rank, image_id> of a returned row: a missing rank is the place, an unusable image id null.

    Valid: a sku of 1 to SKU_BYTES bytes, a rank of 1 or more, usable scores.
    """
    rank = F.coalesce(rank, place)
    ok = sku.isNotNull() & F.octet_length(sku).between(1, SKU_BYTES) & (rank >= 1)
    for s in scores:
        ok = ok & valid_score(s)
    image = F.when(F.octet_length(image_id).between(1, IMAGE_BYTES), image_id)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("valid"), rank.alias("rank"), image.alias("image_id"))


def sane_proposals(proposals: Column, valid) -> Column:
    """Of an array of struct<source, score, box>: the first MOST_PROPOSALS, without invalid boxes, with a source and a finite score or null."""
    first = F.filter(F.slice(proposals, 1, MOST_PROPOSALS), lambda p: valid(p["box"]))
    score = lambda s: F.when(~F.isnan(s) & (F.abs(s) < float("inf")), s)
    return F.transform(first, lambda p: F.struct(p["box"].alias("box"), F.coalesce(p["source"], F.lit("unknown")).alias("source"), score(p["score"]).alias("score")))


def lacking(rows: DataFrame, owner: str, part: str, needed: tuple[str, ...]) -> DataFrame:
    """(owner, missing, extra): which of a fixed set of parts an owner lacks, and what it has besides; both sorted, empty where it's the set."""
    want = F.array(*(F.lit(x) for x in sorted(needed)))
    have = rows.where(F.col(part).isNotNull()).groupBy(owner).agg(*(F.max(F.col(part) == x).alias(f"_{i}") for i, x in enumerate(sorted(needed))), F.array_sort(F.collect_set(F.when(~F.col(part).isin(*needed), F.col(part)))).alias("extra"))
    got = F.filter(F.array(*(F.when(F.col(f"_{i}"), F.lit(x)) for i, x in enumerate(sorted(needed)))), lambda x: x.isNotNull())
    return have.select(owner, F.array_except(want, got).alias("missing"), "extra")


def dense_ids(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``dense_id``: 0, 1, 2, ... in the order of a unique key.

    The rows are cut into ranges of the key; the ranges' sizes are summed, and
    only within a range are rows numbered.
    """
    ranged = materialise(rows.repartitionByRange(F.col(key)).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a task
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.withColumn("_own", own).join(before, "_range").withColumn("dense_id", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def to_blob(df: DataFrame, column: str, blob: str = "blob") -> DataFrame:
    """Adds the little-endian 32-bit floats of an array as binary; null stays null."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return df.withColumn(blob, packed(F.col(column)))


def from_blob(df: DataFrame, blob: str, column: str = "value") -> DataFrame:
    """Adds the array<float> of a binary; null where it's null or its length is no multiple of four."""

    def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return df.withColumn(column, F.pandas_udf(unpacked, "array<float>")(F.col(blob)))
