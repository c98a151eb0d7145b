"""Versions of an index: differences, claims and completion by comparison, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed pattern of the name of a published version.
GENERATION = "generation-[0-9a-f]{32}"


def fingerprint(*columns: str) -> Column:
    """SHA-256 over the JSON of the columns in their order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def same_json(a: Column | str, b: Column | str) -> Column:
    """Whether two JSON texts hold equal values whatever the order of keys; two nulls are equal."""
    read = lambda x: F.to_json(F.try_parse_json(F.col(x) if isinstance(x, str) else x))
    return read(a).eqNullSafe(read(b))


def reconcile(claimed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of claimed rows (key, fingerprint): done if the row is unchanged, stale if it changed, gone if it isn't there."""
    now = current.select(key, F.col("fingerprint").alias("now"))
    rows = claimed.join(now, key, "left")
    return rows.select(key, F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("fingerprint"), "done").otherwise("stale").alias("outcome"))


def reconcile_by_time(rows: DataFrame, key: str, time: str, snapshot: Column) -> DataFrame:
    """(key, indexed): rows last changed strictly before the second of the snapshot are in it."""
    return rows.select(key, (F.date_trunc("second", F.col(time)) < F.date_trunc("second", snapshot)).alias("indexed"))


def latest_revision(mutations: DataFrame, *by: str) -> DataFrame:
    """Mutations brought together: their number and highest revision."""
    return mutations.groupBy(*by).agg(F.count("*").alias("mutations"), F.max("revision").alias("revision"))


def retention(generations: DataFrame, now: Column, keep: int = 3, grace_seconds: int = 3600) -> DataFrame:
    """(name, age_rank, kept, reason) of generations (name, mtime, superseded_at, is_current, size).

    Kept are the current one, the newest ``keep`` by time and name (all for
    keep <= 0), and those superseded within the grace time.  If none is
    current, nothing is removed.
    """
    place = F.row_number().over(Window.orderBy(F.desc("mtime"), F.desc("name")))
    current = F.max(F.col("is_current").cast("int")).over(Window.partitionBy(F.lit(1)))
    age = now.cast("timestamp").cast("bigint") - F.greatest(F.col("mtime"), F.coalesce("superseded_at", "mtime")).cast("timestamp").cast("bigint")
    rows = generations.withColumn("age_rank", place).withColumn("has", current).withColumn("age", age)
    reason = F.when(F.col("is_current"), "current").when(F.coalesce(F.col("has"), F.lit(0)) == 0, "unknown_current").when((F.col("age_rank") <= keep) | F.lit(keep <= 0), "newest").when(F.col("age") < grace_seconds, "grace")
    return rows.select("name", "age_rank", reason.isNotNull().alias("kept"), F.coalesce(reason, F.lit("expired")).alias("reason"), "size")


def reclaimable(plan: DataFrame) -> DataFrame:
    """(removed, bytes, megabytes) that a plan frees."""
    gone = plan.where("NOT kept").agg(F.count("*").alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return gone.withColumn("megabytes", F.round(F.col("bytes") / 1048576, 1))


def confirmed_removals(shown: DataFrame, fresh: DataFrame) -> DataFrame:
    """Names to remove that both the plan that was shown and a fresh one remove."""
    return shown.where("NOT kept").select("name").join(fresh.where("NOT kept").select("name"), "name", "left_semi")
