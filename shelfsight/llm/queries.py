"""The queries p1_ to p8_, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import history, leakage, neighbours, overlap, spans, splits, tokens, topn
from shelfsight.runtime import materialise, table


def p1_lists(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "vectors")
    return neighbours.nearest_lists(neighbours.comparable_vectors(vectors, table(spark, d, "refs")), about=vectors.count())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(p1_lists(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_per_sku(table(spark, d, "search_candidates"), table(spark, d, "refs")).drop("rank")


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "evaluation"), overlap.exported(table(spark, d, "feedback_preview")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_kinds(spark, d).select("eval_id", "feedback_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "evaluation"), p3_kinds(spark, d))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.coverage(table(spark, d, "evaluation"), p3_kinds(spark, d))


def _tags(records: DataFrame) -> DataFrame:
    return records.select("eval_id", F.explode("tags").alias("label"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "evaluation")
    return splits.stratified_splits(materialise(splits.tied_sets(records), "sets"), _tags(records))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_splits(spark, d).where("first <> eval_id").select(F.col("first").alias("first_eval_id"), "eval_id")


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Of each label: its records, and whether every split is within the heaviest set (one at least) of its share; of all sets, whether each is in one split."""
    placed = materialise(p4_splits(spark, d), "splits")
    rows = splits.balance(_tags(table(spark, d, "evaluation")), placed)
    near = F.bool_and(F.abs(F.col("got") - F.col("wanted")) <= F.greatest("heaviest", F.lit(1)))
    whole = placed.groupBy("first").agg(F.count_distinct("split").alias("n")).agg(F.coalesce(F.max("n") == 1, F.lit(True)).alias("whole_sets"))
    return rows.groupBy("label").agg(F.max("records").alias("records"), near.alias("near")).join(whole)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.duplicates_by_batch(table(spark, d, "feedback_preview"), table(spark, d, "refs"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(table(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_passages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where(F.col("run") >= leakage.RUN).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"), p8_found(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_lists": p1_lists,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_kinds": p3_kinds,
    "p3_report": p3_report,
    "p3_coverage": p3_coverage,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_balance": p4_balance,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_share": p8_share,
}
