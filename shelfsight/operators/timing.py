"""Batch forms of the time-bound operators: expiry, pairing, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def expired(events: DataFrame, user: str, time: str, record: str, ttl: int = 900) -> DataFrame:
    """(record, expired): whether a user's next event comes later than the time to live, or never."""
    following = F.lead(F.col("_t")).over(Window.partitionBy(user).orderBy("_t", record))
    rows = events.select(record, user, seconds(time).alias("_t")).withColumn("_n", following)
    return rows.select(record, F.coalesce(F.col("_n") - F.col("_t") > ttl, F.lit(True)).alias("expired"))


def pair_within(left: DataFrame, right: DataFrame, user: str, record: str, time: str, limit: int = 900) -> DataFrame:
    """(right_id, left_id): for each right event the latest left one of its user, at most ``limit`` seconds before.

    An equi-join on the user and a time bucket of the limit's length: what is
    within the limit lies in the same bucket or the one before, so no user's
    events are all compared with each other.  Ties go to the larger id.
    """
    a = left.select(user, F.col(record).alias("left_id"), seconds(time).alias("lt")).withColumn("bucket", F.explode(F.array(F.floor(F.col("lt") / limit), F.floor(F.col("lt") / limit) + 1)))
    b = right.select(user, F.col(record).alias("right_id"), seconds(time).alias("rt")).withColumn("bucket", F.floor(F.col("rt") / limit))
    near = b.join(a, [user, "bucket"]).where((F.col("lt") <= F.col("rt")) & (F.col("rt") - F.col("lt") <= limit))
    return near.groupBy("right_id").agg(F.max(F.struct("lt", "left_id")).alias("m")).select("right_id", F.col("m.left_id").alias("left_id"))


def rate_violations(events: DataFrame, user: str, time: str, window: str, most: int) -> DataFrame:
    """(user, start, n): fixed windows in which a user has more than ``most`` events."""
    w = F.window(F.col(time).cast("timestamp"), window)
    return events.groupBy(user, w.alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most).select(user, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
