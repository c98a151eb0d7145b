"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``group`` in ``order``, which must be total.

    The rank filter on row_number lets the optimiser put a group limit before
    the shuffle, so at most n rows of a group leave each task, however large
    the group is.  Rows with a null group form a group of their own.  Fewer
    than n rows: all of them.  An empty table gives no row.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def scored_hits(candidates: DataFrame, lowest: float = -1.0, highest: float = 1.0) -> DataFrame:
    """(candidate_id, image_id, score) with a valid score and an image; redeliveries still stand in it."""
    score = F.col("score")
    valid = F.col("image_id").isNotNull() & score.isNotNull() & ~F.isnan(score) & score.between(lowest, highest)
    # -0.0 and 0.0 are one score
    return candidates.where(valid).select("candidate_id", "image_id", (score + F.lit(0.0)).alias("score"))


def top_per_sku(candidates: DataFrame, refs: DataFrame, n: int = 5) -> DataFrame:
    """(sku, candidate_id, rank): the n best candidates of each sku of ``refs``.

    sku is the trimmed upper-case sku of the candidate's image; candidates of
    unknown images or with an invalid score are left out, and images with a
    null sku give nothing.  Order: score descending, image_id, candidate_id.
    The candidates are limited per image first, as no image can give a sku
    more than n; only then are they joined and limited per sku.  Redelivered
    rows are equal, so they have one dense rank: the limit goes before the
    first shuffle, and copies are merged behind it without another.
    """
    rank = F.dense_rank().over(Window.partitionBy("image_id").orderBy(F.desc("score"), F.asc("candidate_id")))
    per_image = scored_hits(candidates).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank").distinct()
    images = refs.select("image_id", F.upper(F.trim("sku")).alias("sku")).where("image_id IS NOT NULL AND sku IS NOT NULL").distinct()
    hits = per_image.join(images, "image_id")
    rank = F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("score"), F.asc("image_id"), F.asc("candidate_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= n).select("sku", "candidate_id", "rank")
