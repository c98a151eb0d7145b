"""Queries of the row contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import boxes as B
from shelfsight.operators import contracts as K
from shelfsight.plans.geometry_queries import _SOURCES, _proposals, _sql_boxes
from shelfsight.plans.registry import query
from shelfsight.runtime import table


@query("quality_gate", """WITH f AS (SELECT DISTINCT feedback_id, blur, min_side, crop_pixels, gray_std FROM feedback_preview),
r AS (SELECT *, list_filter([CASE WHEN blur IS NULL OR NOT isfinite(blur) THEN 'missing_blur' WHEN blur < 60 THEN 'low_blur' END, CASE WHEN min_side IS NULL THEN 'missing_size' WHEN min_side < 128 THEN 'too_small' END,
  CASE WHEN crop_pixels < 16384 THEN 'object_too_small' END, CASE WHEN gray_std < 8 THEN 'near_blank' END], lambda x: x IS NOT NULL) AS reasons FROM f)
SELECT feedback_id, len(reasons) = 0 AS fit, array_to_string(reasons, ',') AS reasons FROM r""")
def quality_gate(spark, d):
    rows = table(spark, d, "feedback_preview").select("feedback_id", "blur", "min_side", "crop_pixels", "gray_std").distinct()
    rows = rows.select("feedback_id", K.quality_reasons(*(F.col(c) for c in ("blur", "min_side", "crop_pixels", "gray_std"))).alias("r"))
    return rows.select("feedback_id", (F.size("r") == 0).alias("fit"), F.array_join("r", ",").alias("reasons"))


@query("quality_reason_counts", """WITH f AS (SELECT DISTINCT feedback_id, blur, min_side, crop_pixels, gray_std FROM feedback_preview),
r AS (SELECT unnest([CASE WHEN blur IS NULL OR NOT isfinite(blur) THEN 'missing_blur' WHEN blur < 60 THEN 'low_blur' END, CASE WHEN min_side IS NULL THEN 'missing_size' WHEN min_side < 128 THEN 'too_small' END,
  CASE WHEN crop_pixels < 16384 THEN 'object_too_small' END, CASE WHEN gray_std < 8 THEN 'near_blank' END]) AS reason FROM f)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def quality_reason_counts(spark, d):
    rows = table(spark, d, "feedback_preview").select("feedback_id", "blur", "min_side", "crop_pixels", "gray_std").distinct()
    return rows.select(F.explode(K.quality_reasons(*(F.col(c) for c in ("blur", "min_side", "crop_pixels", "gray_std")))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_SCORES = ("score", "visual_score", "siglip_score", "dino_score", "ocr_score")


@query("candidate_contract", f"""WITH c AS (SELECT DISTINCT candidate_id, rank_pos, sku, image_id, {', '.join(_SCORES)} FROM search_candidates)
SELECT candidate_id, coalesce(sku IS NOT NULL AND octet_length(encode(sku)) BETWEEN 1 AND 255 AND coalesce(rank_pos, 1) >= 1 AND {' AND '.join(f"({s} IS NULL OR (NOT isnan({s}) AND abs({s}) <= 1.000001))" for s in _SCORES)}, false) AS valid,
  coalesce(rank_pos, 1) AS rank, CASE WHEN octet_length(encode(image_id)) BETWEEN 1 AND 512 THEN image_id END AS image_id FROM c""")
def candidate_contract(spark, d):
    rows = table(spark, d, "search_candidates").select("candidate_id", "rank_pos", "sku", "image_id", *_SCORES).distinct()
    return rows.select("candidate_id", K.candidate(F.col("rank_pos"), F.lit(1), F.col("sku"), F.col("image_id"), [F.col(s) for s in _SCORES]).alias("c")).select("candidate_id", "c.*")


@query("extra_projection", """WITH r AS (SELECT DISTINCT ref_id, extra FROM refs), k AS (SELECT ref_id, extra, list_filter(coalesce(json_keys(extra), []), lambda x: x IN ('view', 'reason', 'models')) AS ks FROM r)
SELECT ref_id, array_to_string(list_sort(ks), ',') AS keys, extra ->> '$.view' AS view, len(list_filter(coalesce(json_keys(extra), []), lambda x: regexp_matches(x, '(?i)embedding|vector'))) > 0 AS forbidden, coalesce(strlen(extra) <= 32768, true) AS fits FROM k""")
def extra_projection(spark, d):
    rows = table(spark, d, "refs").select("ref_id", "extra").distinct().withColumn("m", F.from_json("extra", "map<string,string>"))
    kept = K.present(F.col("m"), ("view", "reason", "models"))
    return rows.select("ref_id", F.coalesce(F.array_join(F.array_sort(F.map_keys(kept)), ","), F.lit("")).alias("keys"), F.col("m")["view"].alias("view"), K.forbidden(F.col("m")).alias("forbidden"), K.within_budget(F.col("extra")).alias("fits"))


@query("model_set_check", """WITH v AS (SELECT ref_id, lower(trim(embedding_type)) AS m FROM vectors WHERE embedding_type IS NOT NULL AND ref_id IS NOT NULL)
SELECT ref_id, array_to_string(list_filter(['dino', 'siglip'], lambda x: NOT list_contains(list(m), x)), ',') AS missing, array_to_string(coalesce(list_sort(list(DISTINCT m) FILTER (m NOT IN ('dino', 'siglip'))), []), ',') AS extra FROM v GROUP BY 1""")
def model_set_check(spark, d):
    rows = table(spark, d, "vectors").where("ref_id IS NOT NULL").select("ref_id", F.lower(F.trim("embedding_type")).alias("m"))
    return K.lacking(rows, "ref_id", "m", ("siglip", "dino")).select("ref_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


@query("unwritten_refs", "SELECT DISTINCT ref_id FROM refs WHERE ref_id IS NOT NULL AND ref_id NOT IN (SELECT ref_id FROM vectors WHERE ref_id IS NOT NULL AND value IS NOT NULL AND lower(trim(crop_type)) = 'center')")
def unwritten_refs(spark, d):
    """References of which no centre view is stored."""
    written = table(spark, d, "vectors").where((F.lower(F.trim("crop_type")) == "center") & F.col("value").isNotNull()).select("ref_id")
    return table(spark, d, "refs").where("ref_id IS NOT NULL").select("ref_id").distinct().join(written, "ref_id", "left_anti")


@query("dense_object_ids", "SELECT ref_id, row_number() OVER (ORDER BY ref_id) - 1 AS dense_id FROM (SELECT DISTINCT ref_id FROM refs WHERE lower(trim(representation)) = 'object' AND ref_id IS NOT NULL)")
def dense_object_ids(spark, d):
    rows = table(spark, d, "refs").where((F.lower(F.trim("representation")) == "object") & F.col("ref_id").isNotNull()).select("ref_id").distinct()
    return K.dense_ids(rows, "ref_id")


@query("first_batch_by_id", "SELECT DISTINCT feedback_id FROM feedback_preview WHERE lower(trim(training_status)) IN ('pending', 'exported') ORDER BY feedback_id LIMIT 50")
def first_batch_by_id(spark, d):
    """The first fifty records of some states: a batch, which is the feature."""
    rows = table(spark, d, "feedback_preview").where(F.lower(F.trim("training_status")).isin("pending", "exported"))
    return rows.select("feedback_id").distinct().orderBy("feedback_id").limit(50)


@query("status_counts", "SELECT coalesce(lower(trim(training_status)), 'none') AS status, count(DISTINCT feedback_id) AS n FROM feedback_preview GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "feedback_preview").groupBy(F.coalesce(F.lower(F.trim("training_status")), F.lit("none")).alias("status")).agg(F.count_distinct("feedback_id").alias("n"))


@query("rank_rounding", "SELECT DISTINCT candidate_id, round_even(score * 0.1234567::double, 6) AS score FROM search_candidates WHERE isfinite(score)")
def rank_rounding(spark, d):
    """Scores to six decimals, halves to the even digit, as ranks compare them."""
    rows = table(spark, d, "search_candidates").where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return rows.select("candidate_id", F.bround(F.col("score") * 0.1234567, 6).alias("score")).distinct()


@query("float_blob_codec", "SELECT vec_id, (4 * len(embedding))::int AS bytes, true AS same FROM embeddings WHERE embedding IS NOT NULL")
def float_blob_codec(spark, d):
    rows = K.from_blob(K.to_blob(table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<float>").alias("v")), "v"), "blob", "again")
    return rows.select("vec_id", F.octet_length("blob").alias("bytes"), (F.col("v") == F.col("again")).alias("same"))


@query("proposal_sanitation", f"""WITH {_sql_boxes()}, p AS (SELECT * FROM (SELECT vec_id, n AS k, 0 AS twice, x, y, w, h FROM b UNION ALL SELECT vec_id, n + 4, 1, x, y, -w, h FROM b) WHERE k < 5)
SELECT vec_id AS image_id, count(*) AS kept, round(sum(w * h), 6) AS area, count(*) FILTER (k % 2 = 1) AS unknown FROM p WHERE w >= 0.01 AND h >= 0.01 AND x + w <= 1.0001 AND y + h <= 1.0001 GROUP BY 1""")
def proposal_sanitation(spark, d):
    """Eight proposals an image, of which four are invalid and every second has no source."""
    rows = _proposals(spark, d).select("image_id", "position", "x", "y", "width", "height")
    rows = rows.unionByName(rows.withColumns({"position": F.col("position") + len(_SOURCES), "width": -F.col("width")}))
    entry = F.struct("position", F.when(F.col("position") % 2 == 0, "saliency").alias("source"), F.lit(float("nan")).alias("score"), F.struct("x", "y", "width", "height").alias("box"))
    lists = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("position", entry.alias("e")))).alias("l"))
    kept = lists.select("image_id", F.explode(K.sane_proposals(F.transform("l", lambda x: x["e"]), B.is_valid)).alias("p")).where("p.score IS NULL")
    return kept.groupBy("image_id").agg(F.count("*").alias("kept"), F.round(F.sum(F.col("p.box.width") * F.col("p.box.height")), 6).alias("area"), F.count_if(F.col("p.source") == "unknown").alias("unknown"))
