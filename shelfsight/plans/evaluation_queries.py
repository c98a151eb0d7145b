"""Queries of evaluation, calibration and held-out checks.

The results of an evaluation query are the hits of the search with its id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.operators import evaluation as E
from shelfsight.operators import results as R
from shelfsight.operators import search as S
from shelfsight.plans.registry import query
from shelfsight.plans.search_queries import _SKUS, HIT_ROWS
from shelfsight.runtime import table

QUERIES = """
e0 AS (
  SELECT eval_id AS query_id, min(upper(trim(expected_sku))) AS expected, min(list_sort(list_distinct(list_transform(coalesce(relevant_skus, []), lambda x: upper(trim(x)))))) AS relevant,
    min(list_sort(list_distinct(coalesce(tags, [])))) AS tags, min(coalesce(lower(trim(split)), 'unknown')) AS split, min(coalesce(lower(trim(source)), 'unknown')) AS source,
    min(upper(trim(predicted_sku))) AS predicted, min(rank_pos) AS rank_pos, min(latency_ms) AS latency_ms
  FROM evaluation WHERE eval_id IS NOT NULL GROUP BY 1)"""
JUDGED = f"""{QUERIES}, {HIT_ROWS}, {_SKUS},
t AS (SELECT query_id, sku, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM skr QUALIFY place <= 5),
x AS (SELECT e0.query_id, sku, score, place, list_contains(relevant, sku) AS hit, len(relevant) = 0 AS neg FROM e0 JOIN t USING (query_id))"""


def _counts(threshold: str) -> str:
    return f"""
n AS (
  SELECT e0.query_id, len(relevant) AS n, tags, split, source, count(x.sku) FILTER (hit AND score >= {threshold}) AS tp, count(x.sku) FILTER (NOT hit AND score >= {threshold}) AS fp, count(x.sku) FILTER (score >= {threshold}) AS got
  FROM e0 LEFT JOIN x USING (query_id) GROUP BY ALL)"""


_SUMS = "sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(n - tp)::bigint AS fn, count(*) FILTER (n = 0 AND got = 0) AS tn, count(*) FILTER (n = 0) AS negative, count(*) FILTER (n > 0 AND got = 0) AS rejected, count(*) FILTER (n > 0) AS positive"
_RATIOS = """round(tp / greatest(1, tp + fp), 6) AS precision, round(tp / greatest(1, tp + fn), 6) AS recall,
round(2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-12, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn)), 6) AS f1, round(tn / greatest(1, negative), 6) AS negative_rejection, round(rejected / greatest(1, positive), 6) AS positive_rejection"""
_FIRST = "f AS (SELECT e0.*, x.first FROM e0 LEFT JOIN (SELECT query_id, min(place) FILTER (hit) AS first FROM x GROUP BY 1) x USING (query_id))"
_RANKING = ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0::double ELSE 0 END), 6) AS accuracy_{k}" for k in (1, 3, 5))
_KEPT = ["tp", "fp", "fn", "tn", "negative", "rejected", "positive"]
_SHARES = ["precision", "recall", "f1", "negative_rejection", "positive_rejection"]


def _judged(spark, d):
    skus = S.aggregate_skus(R.sku_hits(table(spark, d, "search_candidates"))).withColumnRenamed("rank", "pos")
    return E.judged(skus, E.clean_queries(table(spark, d, "evaluation")))


def _shares(df):
    return [F.round(c, 6).alias(c) for c in _SHARES]


@query("eval_confusion_counts", f"WITH {JUDGED}, {_counts('0.6')} SELECT {_SUMS} FROM n")
def eval_confusion_counts(spark, d):
    return E.summed(E.confusion(_judged(spark, d), 0.6)).select(*_KEPT)


@query("evaluate_policy", f"WITH {JUDGED}, {_counts('0.706')}, s AS (SELECT {_SUMS} FROM n) SELECT {_RATIOS} FROM s")
def evaluate_policy(spark, d):
    rows = E.ratios(E.summed(E.confusion(_judged(spark, d), 0.706)))
    return rows.select(*_shares(rows))


@query("eval_by_tag", f"WITH {JUDGED}, {_counts('0.6')}, s AS (SELECT unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['unknown'] END) AS tag, * FROM n), g AS (SELECT tag, {_SUMS} FROM s GROUP BY 1) SELECT tag, positive, negative, {_RATIOS} FROM g")
def eval_by_tag(spark, d):
    rows = E.ratios(E.summed(E.exploded_groups(E.confusion(_judged(spark, d), 0.6), "tags", "tag"), "tag"))
    return rows.select("tag", "positive", "negative", *_shares(rows))


@query("eval_by_split_source", f"WITH {JUDGED}, {_counts('0.6')}, g AS (SELECT split, source, {_SUMS} FROM n GROUP BY 1, 2) SELECT split, source, positive, negative, {_RATIOS} FROM g")
def eval_by_split_source(spark, d):
    rows = E.ratios(E.summed(E.confusion(_judged(spark, d), 0.6), "split", "source"))
    return rows.select("split", "source", "positive", "negative", *_shares(rows))


@query("eval_by_family", f"""WITH {JUDGED}, {_counts('0.6')}, fam AS (SELECT upper(trim(sku)) AS sku, min(family) AS family FROM products GROUP BY 1),
ef AS (SELECT query_id, list_sort(list_distinct(list(coalesce(family, 'unknown')))) AS families FROM (SELECT query_id, unnest(CASE WHEN len(relevant) > 0 THEN relevant ELSE [''] END) AS sku FROM e0) LEFT JOIN fam USING (sku) GROUP BY 1),
s AS (SELECT unnest(families) AS family, n.* FROM n JOIN ef USING (query_id)), g AS (SELECT family, {_SUMS} FROM s GROUP BY 1) SELECT family, positive, negative, {_RATIOS} FROM g""")
def eval_by_family(spark, d):
    judged = _judged(spark, d)
    families = table(spark, d, "products").where("sku IS NOT NULL").groupBy(F.upper(F.trim("sku")).alias("sku")).agg(F.min("family").alias("family"))
    own = E.exploded_groups(judged.select("query_id", "relevant"), "relevant", "sku").join(families, "sku", "left")
    lists = own.groupBy("query_id").agg(F.array_sort(F.collect_set(F.coalesce("family", F.lit("unknown")))).alias("families"))
    rows = E.ratios(E.summed(E.exploded_groups(E.confusion(judged, 0.6).join(lists, "query_id"), "families", "family"), "family"))
    return rows.select("family", "positive", "negative", *_shares(rows))


@query("eval_topk_accuracy", f"WITH {JUDGED}, {_FIRST} SELECT count(*) AS positives, {_RANKING} FROM f WHERE len(relevant) > 0")
def eval_topk_accuracy(spark, d):
    return E.ranking_metrics(_judged(spark, d)).select("positives", "accuracy_1", "accuracy_3", "accuracy_5")


_RECALL = ", ".join(f"round(avg((SELECT count(*) FROM x WHERE x.query_id = f.query_id AND hit AND place <= {k}) / len(relevant)), 6) AS recall_{k}" for k in (1, 3, 5))


@query("eval_recall_at_k", f"WITH {JUDGED}, {_FIRST} SELECT {_RECALL} FROM f WHERE len(relevant) > 0")
def eval_recall_at_k(spark, d):
    return E.ranking_metrics(_judged(spark, d)).select("recall_1", "recall_3", "recall_5")


@query("eval_mrr", f"WITH {JUDGED}, {_FIRST} SELECT source, count(*) AS positives, round(avg(CASE WHEN first <= 5 THEN 1 / first ELSE 0 END), 6) AS mrr FROM f WHERE len(relevant) > 0 GROUP BY 1")
def eval_mrr(spark, d):
    return E.ranking_metrics(_judged(spark, d), "source").select("source", "positives", "mrr")


@query("eval_error_rows", f"""WITH {JUDGED}, {_FIRST} SELECT f.query_id, array_to_string(relevant, ',') AS expected, coalesce((SELECT string_agg(sku, ',' ORDER BY place) FROM x WHERE x.query_id = f.query_id), '') AS got, first::int AS first
FROM f WHERE len(relevant) > 0 AND coalesce(first <> 1, true)""")
def eval_error_rows(spark, d):
    return E.error_rows(_judged(spark, d))


@query("latency_median_p95", f"WITH {QUERIES} SELECT source, count(*) AS samples, round(quantile_cont(latency_ms, 0.5), 6) AS median, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM e0 WHERE isfinite(latency_ms) AND latency_ms >= 0 GROUP BY 1")
def latency_median_p95(spark, d):
    return E.latency(E.clean_queries(table(spark, d, "evaluation")), "source")


@query("latency_by_event", "SELECT event_type, count(*) AS samples, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE isfinite(value) AND value >= 0 GROUP BY 1")
def latency_by_event(spark, d):
    return E.latency(table(spark, d, "events"), "event_type", column="value")


_TRIALS = f"""WITH {JUDGED}, base AS (SELECT sum(len(relevant)) AS exp, count(*) FILTER (len(relevant) = 0) AS neg, count(*) FILTER (len(relevant) > 0) AS pos FROM e0),
st AS (SELECT score AS threshold, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp, count(*) FILTER (place = 1 AND neg) AS nfp, count(*) FILTER (place = 1 AND NOT neg) AS acc FROM x GROUP BY 1
  UNION ALL SELECT max(score) + 1e-12, 0, 0, 0, 0 FROM x),
ru AS (SELECT threshold, sum(tp) OVER w AS tp, sum(fp) OVER w AS fp, sum(nfp) OVER w AS nfp, sum(acc) OVER w AS acc FROM st WINDOW w AS (ORDER BY threshold DESC)),
tr AS (SELECT threshold, tp::bigint AS tp, fp::bigint AS fp, (exp - tp)::bigint AS fn, (neg - nfp)::bigint AS tn, neg AS negative, (pos - acc)::bigint AS rejected, pos AS positive FROM ru, base)"""


@query("threshold_sweep", f"{_TRIALS} SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn, rejected, {_RATIOS} FROM tr")
def threshold_sweep(spark, d):
    rows = E.sweep(_judged(spark, d))
    return rows.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn", "rejected", *_shares(rows))


@query("threshold_select", f"{_TRIALS}, z AS (SELECT *, {_RATIOS} FROM tr) SELECT round(threshold, 6) AS threshold, tp, fp, fn, f1 FROM z ORDER BY f1 DESC, negative_rejection DESC, threshold DESC LIMIT 1")
def threshold_select(spark, d):
    return E.best_trial(E.sweep(_judged(spark, d))).select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query("freeze_check", f"{_TRIALS}, z AS (SELECT *, {_RATIOS} FROM tr) SELECT round(threshold, 6) AS threshold, f1 FROM z WHERE round(threshold, 9) = 0.7")
def freeze_check(spark, d):
    return E.freeze(E.sweep(_judged(spark, d)), 0.7).select(F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


_HASH = "CASE WHEN regexp_full_match(lower(trim(photo_hash)), '[0-9a-f]{64}') THEN lower(trim(photo_hash)) END"
_GROUP = "CASE WHEN lower(trim(capture_group)) NOT IN ('', 'unknown-session') THEN lower(trim(capture_group)) END"


def _hash(c="photo_hash"):
    x = F.lower(F.trim(c))
    return F.when(x.rlike("\\A[0-9a-f]{64}\\z"), x)


def _group():
    x = F.lower(F.trim("capture_group"))
    return F.when((x != "") & (x != "unknown-session"), x)


@query("leakage_hash_semi_join", f"SELECT DISTINCT eval_id FROM evaluation WHERE {_HASH} IN (SELECT {_HASH} FROM refs WHERE {_HASH} IS NOT NULL)")
def leakage_hash_semi_join(spark, d):
    known = table(spark, d, "refs").select(_hash().alias("h")).where("h IS NOT NULL").distinct()
    return table(spark, d, "evaluation").select("eval_id", _hash().alias("h")).join(known, "h", "left_semi").select("eval_id").distinct()


@query("leakage_group_semi_join", f"SELECT DISTINCT eval_id FROM evaluation WHERE {_GROUP} IN (SELECT {_GROUP} FROM feedback_preview WHERE {_GROUP} IS NOT NULL)")
def leakage_group_semi_join(spark, d):
    known = table(spark, d, "feedback_preview").select(_group().alias("g")).where("g IS NOT NULL").distinct()
    return table(spark, d, "evaluation").select("eval_id", _group().alias("g")).join(known, "g", "left_semi").select("eval_id").distinct()


@query("tuning_leakage_intersect", f"SELECT {_HASH} AS h FROM evaluation WHERE lower(trim(split)) = 'validation' AND {_HASH} IS NOT NULL INTERSECT SELECT {_HASH} FROM evaluation WHERE lower(trim(split)) = 'test'")
def tuning_leakage_intersect(spark, d):
    e = table(spark, d, "evaluation").select(F.lower(F.trim("split")).alias("s"), _hash().alias("h")).where("h IS NOT NULL")
    return e.where("s = 'validation'").select("h").intersect(e.where("s = 'test'").select("h"))


@query("heldout_validation", f"""WITH e AS (SELECT DISTINCT eval_id, {_HASH} AS h, {_GROUP} AS g, len(relevant_skus) AS n, lower(trim(split)) AS split FROM evaluation),
d AS (SELECT h FROM e WHERE h IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT coalesce(split, 'unknown') AS split, count(*) AS queries, count(*) FILTER (h IN (SELECT h FROM d)) AS duplicate_hash, count(*) FILTER (h IS NULL) AS missing_hash, count(*) FILTER (g IS NULL) AS missing_group, count(*) FILTER (n = 0) AS negative FROM e GROUP BY 1""")
def heldout_validation(spark, d):
    e = table(spark, d, "evaluation").select("eval_id", _hash().alias("h"), _group().alias("g"), F.size("relevant_skus").alias("n"), F.coalesce(F.lower(F.trim("split")), F.lit("unknown")).alias("split")).distinct()
    twice = e.where("h IS NOT NULL").groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("twice"))
    return e.join(twice, "h", "left").groupBy("split").agg(F.count("*").alias("queries"), F.count_if(F.coalesce("twice", F.lit(False))).alias("duplicate_hash"), F.count_if(F.col("h").isNull()).alias("missing_hash"), F.count_if(F.col("g").isNull()).alias("missing_group"), F.count_if(F.col("n") == 0).alias("negative"))


@query("dataset_version_digest", """
WITH l AS (SELECT DISTINCT doc_id, sha256(concat_ws(chr(31), doc_id::varchar, coalesce(text, chr(0)), coalesce(lang, chr(0)))) AS line FROM documents)
SELECT substr(sha256(count(*) || ':' || sum(('0x' || substr(line, 1, 12))::hugeint) || ':' || sum(('0x' || substr(line, 13, 12))::hugeint)), 1, 16) AS digest FROM l""")
def dataset_version_digest(spark, d):
    return E.digest(table(spark, d, "documents"), "doc_id", "text", "lang")


@query("duplicate_hash_frequency", f"SELECT {_HASH} AS h, count(DISTINCT eval_id) AS n FROM evaluation WHERE {_HASH} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT eval_id) > 1")
def duplicate_hash_frequency(spark, d):
    return table(spark, d, "evaluation").select("eval_id", _hash().alias("h")).where("h IS NOT NULL").distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1")


@query("ambiguity_by_source", "SELECT coalesce(lower(trim(source)), 'unknown') AS source, count(DISTINCT eval_id) AS queries, count(DISTINCT eval_id) FILTER (ambiguous) AS ambiguous FROM evaluation GROUP BY 1")
def ambiguity_by_source(spark, d):
    return table(spark, d, "evaluation").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source")).agg(F.count_distinct("eval_id").alias("queries"), F.count_distinct(F.when(F.col("ambiguous"), F.col("eval_id"))).alias("ambiguous"))
