"""Returned hits of searches as clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_or_null(c: str) -> Column:
    """The score if it is within [-1, 1], else null (NaN and what is out of range)."""
    x = F.col(c)
    return F.when(~F.isnan(x) & x.between(-1, 1), x + F.lit(0.0))


def hits(candidates: DataFrame) -> DataFrame:
    """One row per candidate_id with its scores or nulls; redeliveries count once, null searches are left out."""
    scores = [score_or_null(c).alias(c) for c in ("visual_score", "siglip_score", "dino_score", "ocr_score")]
    rows = candidates.where("search_id IS NOT NULL").select("candidate_id", F.col("search_id").alias("query_id"), F.upper(F.trim("sku")).alias("sku"), "image_id", "family", F.round(score_or_null("score"), 9).alias("score"), *scores)
    return rows.distinct()


def sku_hits(candidates: DataFrame) -> DataFrame:
    """The hits that name a sku, as aggregate_skus() takes them."""
    return hits(candidates).where("sku IS NOT NULL").select("query_id", "sku", "image_id", "family", "score")
