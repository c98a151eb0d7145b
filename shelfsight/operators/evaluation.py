"""Evaluation and calibration of ranked results as aggregates.

Results are rows (query_id, sku, score, pos); queries are rows (query_id,
relevant array<string>).  A query without relevant skus is a negative one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.runtime import materialise

DEPTH = 5


def clean_queries(evaluation: DataFrame) -> DataFrame:
    """One row per eval_id: relevant skus trimmed, upper-case, distinct and sorted; tidy tags, split and source.

    Repeated rows count once, null ids are left out, null arrays are empty.
    """
    text = "array<string>"
    skus = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("relevant_skus", F.array().cast(text)), lambda x: x.isNotNull()), lambda x: F.upper(F.trim(x)))))
    tidy = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("unknown")).alias(c)
    rows = evaluation.where("eval_id IS NOT NULL").select(
        F.col("eval_id").alias("query_id"), F.upper(F.trim("expected_sku")).alias("expected"), skus.alias("relevant"), F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast(text)))).alias("tags"),
        tidy("split"), tidy("source"), F.upper(F.trim("predicted_sku")).alias("predicted"), "ambiguous", "rank_pos", "latency_ms",
    )
    return rows.groupBy("query_id").agg(F.min(F.struct(*[c for c in rows.columns if c != "query_id"])).alias("r")).select("query_id", "r.*")


def top_results(skus: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The first ``depth`` results of a query by score, ties in the order of pos."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    return skus.withColumn("place", place).where(F.col("place") <= depth)


def judged(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, relevant, returned array<struct<place, score, sku>>): every query, with its first results in order."""
    lists = top_results(results).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "score", "sku"))).alias("returned"))
    none = F.array().cast("array<struct<place:int,score:double,sku:string>>")
    return queries.join(lists, "query_id", "left").withColumn("returned", F.coalesce("returned", none))


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """Per query: tp, fp, fn, negative, tn, negative_fp and rejected at the threshold."""
    got = F.array_distinct(F.transform(F.filter("returned", lambda x: x["score"] >= threshold), lambda x: x["sku"]))
    rows = rows.withColumn("got", got)
    negative = F.size("relevant") == 0
    nothing = F.size("got") == 0
    return rows.select(
        "*", F.size(F.array_intersect("got", "relevant")).alias("tp"), F.size(F.array_except("got", "relevant")).alias("fp"), F.size(F.array_except("relevant", "got")).alias("fn"),
        negative.cast("int").alias("negative"), (negative & nothing).cast("int").alias("tn"), (negative & ~nothing).cast("int").alias("negative_fp"), (~negative & nothing).cast("int").alias("rejected"),
    )


def _ratio(x: str, y: Column | str) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.col(x) / F.greatest(F.lit(1), y)


def ratios(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, rates and f1 to summed counts; denominators are at least 1 (f1: 1e-12)."""
    rows = counts.withColumns({
        "precision": _ratio("tp", F.col("tp") + F.col("fp")), "recall": _ratio("tp", F.col("tp") + F.col("fn")),
        "fpr": _ratio("negative_fp", "negative"), "fnr": _ratio("fn", F.col("tp") + F.col("fn")),
        "negative_rejection": _ratio("tn", "negative"), "positive_rejection": _ratio("rejected", "positive"),
    })
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", 2 * p * r / F.greatest(F.lit(1e-12), p + r))


COUNTS = ("tp", "fp", "fn", "tn", "negative", "negative_fp", "rejected")


def summed(rows: DataFrame, *by: str) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    return rows.groupBy(*by).agg(*sums, F.coalesce(F.sum(1 - F.col("negative")), F.lit(0)).alias("positive"))


def first_relevant(rows: DataFrame, threshold: float = -2.0) -> Column:
    """1-based place of the first relevant result at or above the threshold; null if there is none."""
    right = F.filter("returned", lambda x: (x["score"] >= threshold) & F.array_contains(F.col("relevant"), x["sku"]))
    return F.array_min(F.transform(right, lambda x: x["place"]))


def ranking_metrics(rows: DataFrame, *by: str, mrr_cutoff: int = 5) -> DataFrame:
    """Over positive queries: accuracy and macro recall at 1, 3, 5 and the mean reciprocal rank."""
    positive = rows.where(F.size("relevant") > 0).withColumn("first", first_relevant(rows))
    out = [F.count("*").alias("positives")]
    for k in (1, 3, 5):
        out.append(F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"accuracy_{k}"))
        got = F.transform(F.slice("returned", 1, k), lambda x: x["sku"])
        out.append(F.round(F.avg(F.size(F.array_intersect("relevant", got)) / F.size("relevant")), 6).alias(f"recall_{k}"))
    out.append(F.round(F.avg(F.when(F.col("first") <= mrr_cutoff, 1 / F.col("first")).otherwise(0.0)), 6).alias("mrr"))
    return positive.groupBy(*by).agg(*out)


def latency(rows: DataFrame, *by: str, column: str = "latency_ms") -> DataFrame:
    """Samples, median and interpolated 95th percentile of finite, non-negative latencies."""
    x = F.col(column)
    good = rows.where(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return good.groupBy(*by).agg(F.count("*").alias("samples"), F.round(F.percentile(column, 0.5), 6).alias("median"), F.round(F.percentile(column, 0.95), 6).alias("p95"))


def running_totals(rows: DataFrame, order: str, columns: list[str], descending: bool = True, parts: int = 16) -> DataFrame:
    """Running sums over all rows in the order of a column that is unique, without one task getting all.

    The rows are range-partitioned; each part is summed up by itself and
    starts from the totals of the parts before, of which there are ``parts``.
    """
    key = F.desc(order) if descending else F.asc(order)
    ranged = materialise(rows.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_part").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("_part").collect()
    before, at = {}, dict.fromkeys(columns, 0)
    for r in sums:
        before[r["_part"]] = dict(at)
        at = {c: at[c] + r[c] for c in columns}
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def start(c: str) -> Column:
        if not before:
            return F.lit(0)
        return F.create_map(*(F.lit(x) for p, t in before.items() for x in (p, t[c])))[F.col("_part")]

    return ranged.select(*[c for c in rows.columns if c not in columns], *((start(c) + F.sum(c).over(w)).alias(c) for c in columns))


def sweep(rows: DataFrame) -> DataFrame:
    """Counts and ratios at every distinct score as threshold, and at one just above the largest (nothing accepted).

    One pass: what each score adds is summed first, then run up from the
    highest; equal scores enter together.
    """
    total = rows.agg(F.coalesce(F.sum(F.size("relevant")), F.lit(0)), F.count_if(F.size("relevant") == 0), F.count_if(F.size("relevant") > 0), F.max(F.array_max(F.transform("returned", lambda x: x["score"])))).first()
    expected, negatives, positives, highest = total
    each = rows.select("query_id", "relevant", F.explode("returned").alias("x"))
    hit = F.array_contains("relevant", F.col("x.sku")).cast("long")
    first = (F.col("x.place") == 1).cast("long")
    no = (F.size("relevant") == 0).cast("long")
    steps = each.groupBy(F.col("x.score").alias("threshold")).agg(F.sum(hit).alias("tp"), F.sum(1 - hit).alias("fp"), F.sum(first * no).alias("negative_fp"), F.sum(first * (1 - no)).alias("accepted"))
    trials = running_totals(steps, "threshold", ["tp", "fp", "negative_fp", "accepted"])
    if highest is not None:
        none = rows.sparkSession.createDataFrame([(math.nextafter(highest, math.inf), 0, 0, 0, 0)], "threshold double, tp bigint, fp bigint, negative_fp bigint, accepted bigint")
        trials = trials.unionByName(none)
    trials = trials.select("threshold", "tp", "fp", (F.lit(expected) - F.col("tp")).alias("fn"), (F.lit(negatives) - F.col("negative_fp")).alias("tn"), F.lit(negatives).cast("bigint").alias("negative"), "negative_fp", (F.lit(positives) - F.col("accepted")).alias("rejected"), F.lit(positives).cast("bigint").alias("positive"))
    return ratios(trials)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial of highest f1, then negative rejection, then threshold."""
    return trials.agg(F.max_by(F.struct(*trials.columns), F.struct(F.round("f1", 12), F.round("negative_rejection", 12), "threshold")).alias("t")).where("t IS NOT NULL").select("t.*")


def freeze(trials: DataFrame, threshold: float) -> DataFrame:
    """The frozen policy (threshold, f1); no row if the threshold was never tried."""
    return trials.where(F.round("threshold", 9) == round(threshold, 9)).select("threshold", "f1")


def exploded_groups(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A row per element of an array column, ``unknown`` where it's empty."""
    values = F.when(F.size(column) > 0, F.col(column)).otherwise(F.array(F.lit("unknown")))
    return rows.withColumn(name, F.explode(values))


def error_rows(rows: DataFrame) -> DataFrame:
    """Positive queries whose first result is not relevant: (query_id, expected, got, first)."""
    wrong = rows.where(F.size("relevant") > 0).withColumn("first", first_relevant(rows)).where(~F.coalesce(F.col("first") == 1, F.lit(False)))
    return wrong.select("query_id", F.array_join("relevant", ",").alias("expected"), F.array_join(F.transform("returned", lambda x: x["sku"]), ",").alias("got"), F.col("first"))


def digest(rows: DataFrame, record: str, *columns: str) -> DataFrame:
    """One row ``digest``: a version of a table's content that needs no order.

    SHA-256 over the number of distinct rows and the sums of two 48-bit parts
    of their own digests, so it is one aggregate, whatever the size.
    """
    line = F.sha2(F.concat_ws("\x1f", F.col(record).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    rows = rows.select(F.col(record).alias("_id"), line.alias("line")).distinct()
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("line", at, 12), 16, 10).cast("decimal(38,0)")).cast("string"), F.lit("0"))
    return rows.agg(F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13)), 256), 1, 16).alias("digest"))


def report(rows: DataFrame) -> str:
    """The metrics of a threshold as one line of text."""
    m = ratios(summed(rows)).first()
    return ", ".join(f"{k} {m[k]:.4g}" for k in ("precision", "recall", "f1", "fpr", "negative_rejection"))
