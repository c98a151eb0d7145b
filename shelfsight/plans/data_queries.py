"""Queries on duplicates, training data, index versions and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import bits
from shelfsight.operators import catalog as C
from shelfsight.operators import dataset as D
from shelfsight.operators import dedup, lifecycle, timing
from shelfsight.plans.registry import query
from shelfsight.runtime import table

_H = "CASE WHEN regexp_full_match(lower(trim(photo_hash)), '[0-9a-f]{64}') THEN lower(trim(photo_hash)) END"
_D = "CASE WHEN regexp_full_match(lower(trim(dhash)), '[0-9a-f]{16}') AND lower(trim(dhash)) <> '0000000000000000' THEN ('0x' || lower(trim(dhash)))::UBIGINT END"
_G = "CASE WHEN lower(trim(capture_group)) NOT IN ('', 'unknown-session') THEN lower(trim(capture_group)) END"
_ONE = f"o AS (SELECT DISTINCT feedback_id AS record, confirmed_product_id AS product, {_H} AS h, {_D} AS d FROM feedback_preview)"
_NEAR = """
e AS (SELECT record, min(b) AS exact FROM (SELECT a.record, b.record AS b FROM o a JOIN o b ON a.h = b.h AND b.record < a.record) GROUP BY 1),
n AS (SELECT a.record, min(b.record) AS near, arg_min(bit_count(xor(a.d, b.d)), b.record)::int AS distance FROM o a JOIN o b ON a.product = b.product AND b.record < a.record AND bit_count(xor(a.d, b.d)) <= 4 GROUP BY 1)"""


def _photos(spark, d):
    return dedup.keyed(table(spark, d, "feedback_preview"), "feedback_id", "confirmed_product_id")


@query("exact_duplicate", f"WITH {_ONE}, {_NEAR} SELECT record, exact FROM e")
def exact_duplicate(spark, d):
    return dedup.first_exact(_photos(spark, d))


@query("near_duplicate_first_by_id", f"WITH {_ONE}, {_NEAR} SELECT record, near, distance FROM n")
def near_duplicate_first_by_id(spark, d):
    return dedup.first_near(_photos(spark, d))


@query("duplicate_decision", f"WITH {_ONE}, {_NEAR} SELECT record, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'near' ELSE 'unique' END AS decision, coalesce(exact, near) AS other, CASE WHEN exact IS NOT NULL THEN 0 ELSE distance END AS distance FROM o LEFT JOIN e USING (record) LEFT JOIN n USING (record)")
def duplicate_decision(spark, d):
    return dedup.decide(_photos(spark, d))


@query("hash_probe", f"SELECT DISTINCT feedback_id FROM feedback_preview WHERE {_H} IN (SELECT {_H} FROM refs WHERE {_H} IS NOT NULL)")
def hash_probe(spark, d):
    known = table(spark, d, "refs").select(bits.valid_hex("photo_hash", 64).alias("h")).where("h IS NOT NULL").distinct()
    return table(spark, d, "feedback_preview").select("feedback_id", bits.valid_hex("photo_hash", 64).alias("h")).join(known, "h", "left_semi").select("feedback_id").distinct()


@query("hash_validity", f"SELECT count(*) AS rows, count(*) FILTER ({_H} IS NULL) AS bad_hash, count(*) FILTER ({_D} IS NULL) AS bad_dhash FROM feedback_preview")
def hash_validity(spark, d):
    return table(spark, d, "feedback_preview").agg(F.count("*").alias("rows"), F.count_if(bits.valid_hex("photo_hash", 64).isNull()).alias("bad_hash"), F.count_if(bits.code("dhash").isNull()).alias("bad_dhash"))


_SAMPLES = f"""
s0 AS (SELECT DISTINCT feedback_id, upper(trim(confirmed_sku)) AS positive_sku, nullif(upper(trim(predicted_sku)), upper(trim(confirmed_sku))) AS hard_negative_sku, {_H} AS hash, {_G} AS grp FROM feedback_preview),
s AS (SELECT *, coalesce(grp, hash) AS key FROM s0 WHERE feedback_id IS NOT NULL AND positive_sku <> '' AND hash IS NOT NULL)"""
_SPLIT = "CASE WHEN b < 0.15 THEN 'test' WHEN b < 0.15 + 0.15 THEN 'validation' ELSE 'train' END AS split"
_BUCKETS = f"k AS (SELECT *, ('0x' || substr(sha256('42' || chr(10) || key), 1, 8))::bigint / 4294967295 AS b FROM s), ks AS (SELECT *, {_SPLIT} FROM k)"


def _samples(spark, d):
    return D.samples(table(spark, d, "feedback_preview"))


@query("training_export", f"WITH {_SAMPLES} SELECT feedback_id, positive_sku, hard_negative_sku, hash, key FROM s")
def training_export(spark, d):
    return _samples(spark, d).drop("group")


@query("hash_split", f"WITH {_SAMPLES}, {_BUCKETS} SELECT feedback_id, key, split FROM ks")
def hash_split(spark, d):
    return _samples(spark, d).select("feedback_id", "key", D.hash_split(F.col("key")).alias("split"))


@query("split_manifest_counts", f"""WITH {_SAMPLES}, {_BUCKETS}, e AS (SELECT split, key, count(*) AS n, count(DISTINCT hash) AS h FROM ks GROUP BY 1, 2)
SELECT split, count(*) AS groups, sum(n)::bigint AS records, sum(h)::bigint AS contents, sum(('0x' || substr(sha256(key), 1, 12))::hugeint)::varchar AS fingerprint FROM e GROUP BY 1""")
def split_manifest_counts(spark, d):
    return D.manifest(_samples(spark, d).withColumn("split", D.hash_split(F.col("key"))), "split")


@query("conflicting_identity_groups", f"WITH {_SAMPLES} SELECT hash, count(DISTINCT grp) AS groups FROM s WHERE grp IS NOT NULL GROUP BY 1 HAVING count(DISTINCT grp) > 1")
def conflicting_identity_groups(spark, d):
    return D.conflicting_identities(_samples(spark, d))


@query("sample_violations", f"""WITH v AS (SELECT DISTINCT feedback_id, coalesce(upper(trim(confirmed_sku)), '') = '' AS a, NOT coalesce(regexp_full_match(upper(trim(confirmed_sku)), '[A-Z0-9_-]+'), true) AS b, {_H} IS NULL AS c,
CASE WHEN regexp_full_match(lower(trim(dhash)), '[0-9a-f]{{16}}') THEN false ELSE true END AS e, {_G} IS NULL AS g, coalesce(upper(trim(confirmed_sku)) = upper(trim(predicted_sku)), false) AS n FROM feedback_preview WHERE feedback_id IS NOT NULL)
SELECT count(*) AS records, count(*) FILTER (a) AS missing_sku, count(*) FILTER (b) AS unsafe_sku, count(*) FILTER (c) AS bad_hash, count(*) FILTER (e) AS bad_dhash, count(*) FILTER (g) AS no_group, count(*) FILTER (n) AS same_negative FROM v""")
def sample_violations(spark, d):
    return D.violations(table(spark, d, "feedback_preview"))


_VERSIONS = """
a AS (SELECT DISTINCT image_id, sku, category, family, photo_hash, representation FROM refs WHERE indexed_at < TIMESTAMP '2026-06-01'),
b AS (SELECT DISTINCT image_id, CASE WHEN indexed_at < TIMESTAMP '2026-03-01' THEN lower(sku) ELSE sku END AS sku, category, family, photo_hash, representation FROM refs WHERE indexed_at >= TIMESTAMP '2026-02-01')"""


def _versions(spark, d):
    r = table(spark, d, "refs")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    cols = ["category", "family", "photo_hash", "representation"]
    a = r.where(F.col("indexed_at") < at("2026-06-01")).select("image_id", "sku", *cols).distinct()
    b = r.where(F.col("indexed_at") >= at("2026-02-01")).select("image_id", F.when(F.col("indexed_at") < at("2026-03-01"), F.lower("sku")).otherwise(F.col("sku")).alias("sku"), *cols).distinct()
    return a, b, ["sku", *cols]


@query("index_diff_classify", f"""WITH {_VERSIONS} SELECT coalesce(a.image_id, b.image_id) AS image_id, CASE WHEN a.image_id IS NULL THEN 'new' WHEN b.image_id IS NULL THEN 'deleted'
WHEN (a.sku, a.category, a.family, a.photo_hash, a.representation) IS NOT DISTINCT FROM (b.sku, b.category, b.family, b.photo_hash, b.representation) THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b USING (image_id)""")
def index_diff_classify(spark, d):
    a, b, columns = _versions(spark, d)
    return C.classify(a, b, "image_id", columns)


@query("claim_reconcile", f"""WITH {_VERSIONS} SELECT a.image_id, CASE WHEN b.image_id IS NULL THEN 'gone' WHEN (a.sku, a.category, a.family, a.photo_hash, a.representation) IS NOT DISTINCT FROM (b.sku, b.category, b.family, b.photo_hash, b.representation) THEN 'done' ELSE 'stale' END AS outcome FROM a LEFT JOIN b USING (image_id)""")
def claim_reconcile(spark, d):
    a, b, columns = _versions(spark, d)
    seen = lambda df: df.select("image_id", lifecycle.fingerprint(*columns).alias("fingerprint"))
    return lifecycle.reconcile(seen(a), seen(b), "image_id")


@query("snapshot_reconcile", "SELECT o_orderkey, date_trunc('second', o_orderdate) < TIMESTAMP '1995-06-15 12:00:00' AS indexed FROM orders")
def snapshot_reconcile(spark, d):
    return lifecycle.reconcile_by_time(table(spark, d, "orders"), "o_orderkey", "o_orderdate", F.lit("1995-06-15 12:00:00.7").cast("timestamp_ntz"))


@query("retention_plan", """
WITH g AS (SELECT strftime(indexed_at, '%Y-%m-%d') AS name, max(date_trunc('second', indexed_at)) AS mtime, count(*) AS size FROM (SELECT DISTINCT * FROM refs) WHERE indexed_at IS NOT NULL GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, name DESC) AS age_rank, name = (SELECT max(name) FROM g) AS cur, lag(mtime) OVER (ORDER BY name DESC) AS superseded_at FROM g)
SELECT name, age_rank::int AS age_rank, cur OR age_rank <= 3 OR age < 259200 AS kept, CASE WHEN cur THEN 'current' WHEN age_rank <= 3 THEN 'newest' WHEN age < 259200 THEN 'grace' ELSE 'expired' END AS reason, size
FROM (SELECT *, epoch(TIMESTAMP '2026-10-05' - greatest(mtime, coalesce(superseded_at, mtime))) AS age FROM w)""")
def retention_plan(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "refs").distinct().where("indexed_at IS NOT NULL")
    g = rows.groupBy(F.date_format("indexed_at", "yyyy-MM-dd").alias("name")).agg(F.max(F.date_trunc("second", "indexed_at")).alias("mtime"), F.count("*").alias("size"))
    # days are few, so their windows may be in one task
    g = g.withColumn("superseded_at", F.lag("mtime").over(Window.orderBy(F.desc("name")))).withColumn("is_current", F.col("name") == F.max("name").over(Window.partitionBy(F.lit(1))))
    return lifecycle.retention(g, F.lit("2026-10-05").cast("timestamp_ntz"), keep=3, grace_seconds=259200)


@query("evidence_ttl_expired", "SELECT event_id, coalesce(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts) > 900, true) AS expired FROM events")
def evidence_ttl_expired(spark, d):
    return timing.expired(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("confirmation_within_15m", "SELECT p.event_id AS right_id, arg_max(v.event_id, (v.ts, v.event_id)) AS left_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND v.ts <= p.ts AND epoch(p.ts - v.ts) <= 900 WHERE p.event_type = 'purchase' GROUP BY 1")
def confirmation_within_15m(spark, d):
    e = table(spark, d, "events")
    return timing.pair_within(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "event_id", "ts")


@query("rate_limit_violations", "SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 5")
def rate_limit_violations(spark, d):
    return timing.rate_violations(table(spark, d, "events"), "user_id", "ts", "1 day", 5)


@query("dirty_revision_coalesce", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS mutations, max(event_id) AS revision FROM events GROUP BY 1, 2")
def dirty_revision_coalesce(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.col("event_id").alias("revision"))
    return lifecycle.latest_revision(e, "day", "event_type")


@query("late_deliveries", "SELECT batch_no, count(*) AS rows, count(DISTINCT feedback_id) AS records, count(*) FILTER (epoch(received_at - created_at) > 259200) AS late FROM feedback_preview GROUP BY 1")
def late_deliveries(spark, d):
    late = timing.seconds("received_at") - timing.seconds("created_at") > 259200
    return table(spark, d, "feedback_preview").groupBy("batch_no").agg(F.count("*").alias("rows"), F.count_distinct("feedback_id").alias("records"), F.count_if(late).alias("late"))


@query("idempotent_redelivery", "SELECT candidate_id, count(*) AS deliveries, min(ingested_at) AS first_seen FROM search_candidates GROUP BY 1 HAVING count(*) > 1")
def idempotent_redelivery(spark, d):
    return table(spark, d, "search_candidates").groupBy("candidate_id").agg(F.count("*").alias("deliveries"), F.min("ingested_at").alias("first_seen")).where("deliveries > 1")


@query("source_histogram", "SELECT coalesce(lower(trim(source)), 'unknown') AS source, count(DISTINCT feedback_id) AS records, round(avg(blur), 4) AS blur FROM (SELECT DISTINCT feedback_id, source, CASE WHEN isfinite(blur) THEN blur END AS blur FROM feedback_preview) GROUP BY 1")
def source_histogram(spark, d):
    blur = F.when(~F.isnan("blur") & (F.abs("blur") < float("inf")), F.col("blur"))
    rows = table(spark, d, "feedback_preview").select("feedback_id", F.coalesce(F.lower(F.trim("source")), F.lit("unknown")).alias("source"), blur.alias("blur")).distinct()
    return rows.groupBy("source").agg(F.count_distinct("feedback_id").alias("records"), F.round(F.avg("blur"), 4).alias("blur"))
