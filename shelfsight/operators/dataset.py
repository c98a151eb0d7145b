"""Training export, splits by hash, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsight.functions import bits

NO_GROUP = "unknown-session"


def clean_group(c: str = "capture_group") -> Column:
    x = F.lower(F.trim(c))
    return F.when((x != "") & (x != NO_GROUP), x)


def group_key(group: Column, content: Column) -> Column:
    """The capture group, or the content hash where there is none."""
    return F.coalesce(group, content)


def hash_split(key: Column, seed: int | str = 42, validation: float = 0.15, test: float = 0.15) -> Column:
    """train, validation or test by the first 32 bits of SHA-256 over seed, newline and key; null for a null key."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}\n"), key), 256), 1, 8), 16, 10).cast("bigint") / F.lit(float(0xFFFFFFFF))
    return F.when(key.isNull(), None).when(bucket < test, "test").when(bucket < test + validation, "validation").otherwise("train")


def samples(feedback: DataFrame) -> DataFrame:
    """(feedback_id, positive_sku, hard_negative_sku, hash, group, key), each record once.

    The prediction is a hard negative where it differs from the confirmed
    sku; records without a confirmed sku or content hash are left out.
    """
    positive, predicted = F.upper(F.trim("confirmed_sku")), F.upper(F.trim("predicted_sku"))
    rows = feedback.select("feedback_id", positive.alias("positive_sku"), F.nullif(predicted, positive).alias("hard_negative_sku"), bits.valid_hex("photo_hash", 64).alias("hash"), clean_group().alias("group"))
    rows = rows.where("feedback_id IS NOT NULL AND positive_sku <> '' AND hash IS NOT NULL").distinct()
    return rows.withColumn("key", group_key(F.col("group"), F.col("hash")))


def conflicting_identities(rows: DataFrame) -> DataFrame:
    """(hash, groups): content that occurs under several groups."""
    return rows.where("hash IS NOT NULL AND group IS NOT NULL").groupBy("hash").agg(F.count_distinct("group").alias("groups")).where("groups > 1")


def violations(feedback: DataFrame) -> DataFrame:
    """One row of counts: what makes a record unfit for training."""
    sku, other = F.upper(F.trim("confirmed_sku")), F.upper(F.trim("predicted_sku"))
    bad = {
        "missing_sku": sku.isNull() | (sku == ""), "unsafe_sku": ~F.coalesce(sku.rlike(r"\A[A-Z0-9_-]+\z"), F.lit(True)),
        "bad_hash": bits.valid_hex("photo_hash", 64).isNull(), "bad_dhash": bits.valid_hex("dhash", 16).isNull(), "no_group": clean_group().isNull(), "same_negative": F.coalesce(sku == other, F.lit(False)),
    }
    rows = feedback.where("feedback_id IS NOT NULL").select("feedback_id", *(c.alias(n) for n, c in bad.items())).distinct()
    return rows.agg(F.count("*").alias("records"), *(F.count_if(F.col(n)).alias(n) for n in bad))


def manifest(rows: DataFrame, *by: str) -> DataFrame:
    """Groups, records, distinct content and a fingerprint of the keys of each split.

    The fingerprint adds up 48-bit hash parts of the distinct keys, so it
    needs no order and no list of all keys.
    """
    part = F.conv(F.substring(F.sha2("key", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    each = rows.groupBy(*by, "key").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("h"))
    return each.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("n").alias("records"), F.sum("h").alias("contents"), F.sum(part).cast("string").alias("fingerprint"))
