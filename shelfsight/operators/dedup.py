"""Duplicates of photos: exact by content hash, near by perceptual hash within a product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions import bits


def keyed(rows: DataFrame, record: str, product: str) -> DataFrame:
    """(record, product, hash, code), each record once."""
    return rows.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.col(product).alias("product"), bits.valid_hex("photo_hash", 64).alias("hash"), bits.code("dhash").alias("code")).groupBy("record").agg(F.min(F.struct("product", "hash", "code")).alias("r")).select("record", "r.*")


def first_exact(rows: DataFrame) -> DataFrame:
    """(record, exact): the smallest other record of the same content hash, where it's smaller."""
    first = rows.where("hash IS NOT NULL").groupBy("hash").agg(F.min("record").alias("exact"))
    return rows.join(first, "hash").where("record > exact").select("record", "exact")


def first_near(rows: DataFrame, most: int = bits.DISTANCE) -> DataFrame:
    """(record, near, distance): the smallest earlier record of the product whose code differs in at most ``most`` bits.

    It is the first by id, not the nearest.  Codes are compared by the pieces
    that close codes share, with equal codes of a product merged first; a
    product may hold any number of records.
    """
    if most > bits.DISTANCE:
        raise ValueError("the pieces find distances up to 4 only")
    some = rows.where("code IS NOT NULL AND product IS NOT NULL")
    # of equal codes the first two records are enough: a later copy's first hit is no later than the first
    one = some.groupBy("product", "code").agg(F.min("record").alias("first"))
    keys = one.select("product", "code", "first", F.explode(bits.pieces_keys(F.col("code"))).alias("key"))
    other = keys.select("product", "key", F.col("code").alias("other"), F.col("first").alias("near"))
    near = keys.join(other, ["product", "key"]).where(bits.distance("code", "other") <= most).select("product", "code", "near", "other").distinct()
    # (near, distance) by code; a record takes the smallest that comes before it, which is that of its code unless it is the code's first record
    least = near.groupBy("product", "code").agg(F.min(F.struct("near", bits.distance("code", "other").alias("distance"))).alias("n"))
    found = some.join(least, ["product", "code"]).where(F.col("n.near") < F.col("record"))
    return found.select("record", F.col("n.near").alias("near"), F.col("n.distance").cast("int").alias("distance"))


def decide(rows: DataFrame, most: int = bits.DISTANCE) -> DataFrame:
    """(record, decision, other, distance): exact before near before unique."""
    both = rows.select("record").join(first_exact(rows), "record", "left").join(first_near(rows, most), "record", "left")
    kind: Column = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("unique")
    return both.select("record", kind.alias("decision"), F.coalesce("exact", "near").alias("other"), F.when(F.col("exact").isNotNull(), 0).otherwise(F.col("distance")).alias("distance"))
