"""Queries of vector search, fusion, scoring and decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.functions import vectors as V
from shelfsight.operators import results as R
from shelfsight.operators import search as S
from shelfsight.plans.registry import query
from shelfsight.runtime import materialise, table
from shelfsight.settings import Settings

SETTINGS = Settings()

REFS = """
r AS (SELECT DISTINCT ref_id, image_id, upper(trim(sku)) AS sku, lower(trim(category)) AS category, family, lower(trim(representation)) AS representation FROM refs WHERE sku IS NOT NULL),
q AS (SELECT ref_id AS query_id, coalesce(representation = 'object', false) AS o FROM r WHERE ref_id % 50 = 0)"""
VECTORS = """
v0 AS (
  SELECT ref_id, lower(trim(embedding_type)) AS model, lower(trim(crop_type)) AS view, arg_min(value, vector_id) AS value FROM vectors
  WHERE len(value) = dimension AND len(list_filter(value, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(value, lambda x: x <> 0)) > 0
  GROUP BY 1, 2, 3),
v1 AS (SELECT ref_id, model, view, list_transform(value, lambda x: x::double) AS value FROM v0),
v AS (SELECT ref_id, model, view, list_transform(value, lambda x: x / sqrt(list_dot_product(value, value))) AS value FROM v1),
s AS (SELECT v.ref_id, model, value, sku, representation, category FROM v JOIN r USING (ref_id) WHERE view = 'global')"""


def _top(k: int, where: str = "true", more: str = "") -> str:
    return f"""
p AS (
  SELECT a.ref_id AS query_id, b.ref_id, round(greatest(-1, least(1, list_dot_product(a.value, b.value))), 9) AS score
  FROM s a JOIN q ON a.ref_id = q.query_id JOIN s b ON a.model = b.model AND a.ref_id <> b.ref_id WHERE a.model = 'dino' AND {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM p {more} QUALIFY rank <= {k})"""


_OUT = "SELECT query_id, ref_id, rank::int AS rank, round(score, 6) AS similarity FROM t"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # cleaned once and written, as every list reads them
    return materialise(S.clean_refs(table(spark, d, "refs")), "refs"), materialise(S.clean_vectors(table(spark, d, "vectors")), "vectors")


def _one_list(refs: DataFrame, vectors: DataFrame, k: int, stored: DataFrame | None = None) -> DataFrame:
    whole = vectors.where("view = 'global' AND model = 'dino'").join(refs.select("ref_id"), "ref_id", "left_semi").select("ref_id", "value")
    own = whole.withColumnRenamed("ref_id", "query_id").join(S.query_set(refs), "query_id", "left_semi")
    return S.vector_top_k(own, whole if stored is None else whole.join(stored.select("ref_id"), "ref_id", "left_semi"), k)


def _similar(df: DataFrame) -> DataFrame:
    return df.select("query_id", "ref_id", "rank", F.round("score", 6).alias("similarity"))


@query("vector_topk_cosine", f"WITH {REFS}, {VECTORS}, {_top(10)} {_OUT}")
def vector_topk_cosine(spark, d):
    return _similar(_one_list(*_sides(spark, d), 10))


@query("vector_topk_prefilter_category", f"WITH {REFS}, {VECTORS}, {_top(10, "b.category = 'lighting'")} {_OUT}")
def vector_topk_prefilter_category(spark, d):
    refs, vectors = _sides(spark, d)
    return _similar(_one_list(refs, vectors, 10, refs.where("category = 'lighting'")))


@query("vector_topk_objects", f"WITH {REFS}, {VECTORS}, {_top(10, "b.representation = 'object'")} {_OUT}")
def vector_topk_objects(spark, d):
    refs, vectors = _sides(spark, d)
    return _similar(_one_list(refs, vectors, 10, refs.where("representation = 'object'")))


@query("vector_threshold_limit", f"WITH {REFS}, {VECTORS}, {_top(12, more='WHERE score >= 0.72')} {_OUT}")
def vector_threshold_limit(spark, d):
    return _similar(_one_list(*_sides(spark, d), 12).where("score >= 0.72"))


def _top_by_model(k: int, where: str = "true", more: str = "") -> str:
    return f"""
p AS (
  SELECT a.model, a.ref_id AS query_id, b.ref_id, round(greatest(-1, least(1, list_dot_product(a.value, b.value))), 9) AS score
  FROM s a JOIN q ON a.ref_id = q.query_id JOIN s b ON a.model = b.model AND a.ref_id <> b.ref_id WHERE {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, ref_id) AS rank FROM p {more} QUALIFY rank <= {k})"""


_OUT_BY_MODEL = "SELECT model, query_id, ref_id, rank::int AS rank, round(score, 6) AS similarity FROM t"


def _list_per_model(refs: DataFrame, vectors: DataFrame, k: int, stored: DataFrame | None = None) -> DataFrame:
    # _one_list() over all models in one scan
    whole = vectors.where("view = 'global'").join(refs.select("ref_id"), "ref_id", "left_semi").select("ref_id", F.col("model").alias("list"), "value")
    own = whole.withColumnRenamed("ref_id", "query_id").join(S.query_set(refs), "query_id", "left_semi")
    held = whole if stored is None else whole.join(stored.select("ref_id"), "ref_id", "left_semi")
    return S.list_tops(own, held.select("ref_id", F.array("list").alias("lists"), "value"), k, own.count())


def _similar_by_model(df: DataFrame) -> DataFrame:
    return df.select(F.col("list").alias("model"), "query_id", "ref_id", "rank", F.round("score", 6).alias("similarity"))


@query("vector_topk_cosine_by_model", f"WITH {REFS}, {VECTORS}, {_top_by_model(10)} {_OUT_BY_MODEL}")
def vector_topk_cosine_by_model(spark, d):
    return _similar_by_model(_list_per_model(*_sides(spark, d), 10))


@query("vector_topk_prefilter_category_by_model", f"WITH {REFS}, {VECTORS}, {_top_by_model(10, "b.category = 'lighting'")} {_OUT_BY_MODEL}")
def vector_topk_prefilter_category_by_model(spark, d):
    refs, vectors = _sides(spark, d)
    return _similar_by_model(_list_per_model(refs, vectors, 10, refs.where("category = 'lighting'")))


@query("vector_topk_objects_by_model", f"WITH {REFS}, {VECTORS}, {_top_by_model(10, "b.representation = 'object'")} {_OUT_BY_MODEL}")
def vector_topk_objects_by_model(spark, d):
    refs, vectors = _sides(spark, d)
    return _similar_by_model(_list_per_model(refs, vectors, 10, refs.where("representation = 'object'")))


@query("vector_threshold_limit_by_model", f"WITH {REFS}, {VECTORS}, {_top_by_model(12, more='WHERE score >= 0.72')} {_OUT_BY_MODEL}")
def vector_threshold_limit_by_model(spark, d):
    return _similar_by_model(_list_per_model(*_sides(spark, d), 12).where("score >= 0.72"))


@query("vector_normalize", """
SELECT vector_id, CASE WHEN ok THEN round(sqrt(list_dot_product(w, w)), 4) END AS norm, ok AS valid,
  CASE WHEN ok THEN round(list_dot_product(list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))), list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))), 6) END AS unit
FROM (SELECT vector_id, list_transform(value, lambda x: x::double) AS w, coalesce(len(value) > 0 AND len(list_filter(value, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(value, lambda x: x <> 0)) > 0, false) AS ok FROM vectors)
""")
def vector_normalize(spark, d):
    unit = V.normalize("value")
    return table(spark, d, "vectors").select("vector_id", F.when(V.is_valid("value"), F.round(V.norm("value"), 4)).alias("norm"), V.is_valid("value").alias("valid"), F.round(V.dots(unit, unit), 6).alias("unit"))


@query("padded_cosine", f"""WITH {REFS}, {VECTORS}, b AS (SELECT a.ref_id, a.value AS x, list_resize(list_slice(b.value, 1, len(a.value)), len(a.value), 0.0) AS y FROM v a JOIN v b USING (ref_id, view) WHERE a.model = 'siglip' AND b.model = 'dino' AND view = 'global')
SELECT ref_id, round(coalesce(list_dot_product(x, y) / nullif(sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)), 0), 0), 6) AS similarity FROM b""")
def padded_cosine(spark, d):
    v = _sides(spark, d)[1].where("view = 'global'")
    a, b = (v.where(F.col("model") == m).select("ref_id", F.col("value").alias(m)) for m in ("siglip", "dino"))
    return a.join(b, "ref_id").select("ref_id", F.round(V.padded_cosine("siglip", "dino"), 6).alias("similarity"))


@query("vector_text_codec", "SELECT vector_id, len(value) AS n, round(list_sum(list_transform(list_filter(value, lambda x: isfinite(x)), lambda x: x::double)), 4) AS total FROM vectors WHERE value IS NOT NULL")
def vector_text_codec(spark, d):
    back = V.parse_vector(V.format_vector(F.transform(F.filter("value", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), lambda x: x.cast("double"))))
    return table(spark, d, "vectors").where("value IS NOT NULL").select("vector_id", F.size("value").cast("bigint").alias("n"), F.round(V.total(back), 4).alias("total"))


_LISTS = """
l AS (
  SELECT a.ref_id AS query_id, a.model || ':' || x.name AS list, b.ref_id, round(greatest(-1, least(1, list_dot_product(a.value, b.value))), 9) AS score,
    CASE WHEN x.name = 'object' THEN m.w * 0.8 WHEN q.o THEN m.w * (1 - 0.8) ELSE m.w END AS weight
  FROM s a JOIN q ON a.ref_id = q.query_id JOIN (VALUES ('siglip', 0.35::double), ('dino', 0.65::double)) m(model, w) ON a.model = m.model
    JOIN s b ON a.model = b.model AND a.ref_id <> b.ref_id JOIN (VALUES ('all'), ('object')) x(name) ON x.name = 'all' OR (q.o AND b.representation = 'object')
  QUALIFY row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, b.ref_id) <= 50),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY score DESC, ref_id) AS rank FROM l),
f AS (SELECT query_id, ref_id, round(sum(weight / (60 + rank)), 12) AS fused FROM lr GROUP BY 1, 2)"""
_CAP = """
k AS (SELECT f.*, sku, image_id, family, coalesce(representation = 'object', false) AS ro FROM f JOIN r USING (ref_id) QUALIFY row_number() OVER (PARTITION BY query_id, sku ORDER BY fused DESC, ref_id) <= 3),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, ref_id) AS place FROM k QUALIFY place <= 50)"""
_SCORES = """
w AS (SELECT ref_id, model, min(value) FILTER (view = 'global') AS whole, coalesce(list(value ORDER BY view) FILTER (view <> 'global'), []) AS views FROM v GROUP BY 1, 2),
m AS (
  SELECT c.query_id, c.ref_id, a.model, q.o, c.ro, round(greatest(-1, least(1, list_dot_product(a.whole, b.whole))), 9) AS context,
    CASE WHEN len(a.views) > 0 AND len(b.views) > 0 THEN greatest(-1, least(1, (
      list_avg(list_transform(a.views, lambda x: list_max(list_transform(b.views, lambda y: list_dot_product(x, y))))) +
      list_avg(list_transform(b.views, lambda x: list_max(list_transform(a.views, lambda y: list_dot_product(x, y)))))) / 2)) END AS local
  FROM c JOIN q USING (query_id) JOIN w a ON a.ref_id = c.query_id JOIN w b ON b.ref_id = c.ref_id AND a.model = b.model WHERE a.whole IS NOT NULL AND b.whole IS NOT NULL),
mo AS (SELECT *, round(greatest(-1, least(1, 0.5 * context + 0.5 * coalesce(local, context))), 9) AS object FROM m),
ms AS (SELECT *, CASE WHEN o <> ro THEN context ELSE object END AS score FROM mo),
vs AS (
  SELECT query_id, ref_id, max(score) FILTER (model = 'siglip') AS siglip_score, max(score) FILTER (model = 'dino') AS dino_score,
    round(greatest(-1, least(1, sum(score * CASE model WHEN 'siglip' THEN 0.35::double ELSE 0.65 END) / sum(CASE WHEN score IS NOT NULL THEN CASE model WHEN 'siglip' THEN 0.35::double ELSE 0.65 END END))), 9) AS visual_score
  FROM ms WHERE model IN ('siglip', 'dino') GROUP BY 1, 2)"""
_SKUS = """
sk AS (
  SELECT query_id, sku, max(score) AS score, (list({'i': image_id} ORDER BY score DESC, image_id NULLS LAST))[1].i AS image_id, (list({'f': family} ORDER BY score DESC, image_id NULLS LAST, family NULLS LAST))[1].f AS family, count(*) AS matched_images, string_agg(image_id, ',' ORDER BY score DESC, image_id) AS evidence
  FROM rows WHERE score IS NOT NULL GROUP BY 1, 2),
skr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sku) AS rank FROM sk)"""


def _decide(threshold: str = "-2") -> str:
    return f"""
g AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS gap, score >= {threshold} AS passes, max(CASE WHEN score >= {threshold} THEN score END) OVER (PARTITION BY query_id) AS top FROM skr),
gt AS (SELECT *, passes AND rank <= 5 AND round(top - score, 9) <= 0.05 AS tied FROM g),
d0 AS (
  SELECT query_id, max(score) FILTER (rank = 1) AS first, round(max(gap) FILTER (rank = 1), 9) AS score_gap, count(*) FILTER (passes) AS kept, count(*) FILTER (tied) AS n,
    count(DISTINCT family) FILTER (tied) AS families, coalesce(string_agg(sku, ',' ORDER BY rank) FILTER (tied), '') AS alternatives
  FROM gt GROUP BY 1),
d AS (
  SELECT query_id, score_gap, kept, alternatives, n >= 2 AS ambiguous, CASE WHEN n >= 2 AND families = 1 THEN 'same_family_variants' WHEN n >= 2 THEN 'near_tie' END AS reason,
    CASE WHEN kept = 0 THEN 'low' WHEN first >= 0.85 AND score_gap >= 0.08 THEN 'high' WHEN first >= 0.7 THEN 'medium' ELSE 'low' END AS confidence
  FROM d0)"""


@query("rrf_fusion", f"WITH {REFS}, {VECTORS}, {_LISTS} SELECT query_id, ref_id, round(fused, 9) AS fused FROM f")
def rrf_fusion(spark, d):
    refs, vectors = _sides(spark, d)
    return S.fuse_ranks(S.shortlists(S.query_set(refs), refs, vectors, SETTINGS), SETTINGS.rank_bias).withColumn("fused", F.round("fused", 9))


@query("shortlist_union", f"WITH {REFS}, {VECTORS}, {_LISTS} SELECT query_id, ref_id, count(*) AS lists, min(rank)::int AS best_rank, round(max(score), 6) AS best FROM lr GROUP BY 1, 2")
def shortlist_union(spark, d):
    refs, vectors = _sides(spark, d)
    rows = S.shortlists(S.query_set(refs), refs, vectors, SETTINGS)
    return rows.groupBy("query_id", "ref_id").agg(F.count("*").alias("lists"), F.min("rank").alias("best_rank"), F.round(F.max("score"), 6).alias("best"))


@query("per_sku_cap", f"WITH {REFS}, {VECTORS}, {_LISTS}, {_CAP} SELECT query_id, ref_id, sku, place::int AS place FROM c")
def per_sku_cap(spark, d):
    refs, vectors = _sides(spark, d)
    fused = S.fuse_ranks(S.shortlists(S.query_set(refs), refs, vectors, SETTINGS), SETTINGS.rank_bias)
    return S.cap_per_sku(fused, refs, 3, 50).select("query_id", "ref_id", "sku", "place")


@query("model_local_score", f"WITH {REFS}, {VECTORS}, {_LISTS}, {_CAP}, {_SCORES} SELECT query_id, ref_id, model, round(context, 6) AS context, round(object, 6) AS object, round(score, 6) AS score FROM ms")
def model_local_score(spark, d):
    refs, vectors = _sides(spark, d)
    queries = S.query_set(refs)
    capped = S.cap_per_sku(S.fuse_ranks(S.shortlists(queries, refs, vectors, SETTINGS)), refs, 3, 50)
    is_object = F.coalesce(F.col("representation") == "object", F.lit(False))
    pairs = capped.join(queries.select("query_id", F.coalesce("is_object", F.lit(False)).alias("q_object")), "query_id").join(refs.select("ref_id", is_object.alias("r_object")), "ref_id")
    rows = S.model_scores(pairs.select("query_id", "ref_id", "q_object", "r_object"), vectors, SETTINGS)
    return rows.select("query_id", "ref_id", "model", *(F.round(c, 6).alias(c) for c in ("context", "object", "score")))


@query("mixed_representation_fallback", f"WITH {REFS}, {VECTORS}, {_LISTS}, {_CAP}, {_SCORES} SELECT c.query_id, c.ref_id, sku, round(visual_score, 6) AS visual_score, round(siglip_score, 6) AS siglip_score, round(dino_score, 6) AS dino_score FROM c JOIN vs USING (query_id, ref_id)")
def mixed_representation_fallback(spark, d):
    rows = S.candidates(*_sides(spark, d), SETTINGS)
    return rows.select("query_id", "ref_id", "sku", *(F.round(c, 6).alias(c) for c in ("visual_score", "siglip_score", "dino_score")))


@query("search_end_to_end", f"""WITH {REFS}, {VECTORS}, {_LISTS}, {_CAP}, {_SCORES},
rows AS (SELECT c.query_id, c.sku, c.image_id, c.family, vs.visual_score AS score FROM c JOIN vs USING (query_id, ref_id)), {_SKUS}, {_decide()}
SELECT query_id, rank::int AS rank, sku, image_id, round(score, 6) AS score, matched_images, evidence, confidence, ambiguous FROM skr JOIN d USING (query_id) WHERE rank <= 5""")
def search_end_to_end(spark, d):
    return S.search(*_sides(spark, d), SETTINGS).withColumn("score", F.round("score", 6))


# -- the returned hits of search_candidates -------------------------------------------------

HITS = """
h AS (
  SELECT DISTINCT candidate_id, search_id AS query_id, upper(trim(sku)) AS sku, image_id, family,
    CASE WHEN score BETWEEN -1 AND 1 THEN round(score, 9) + 0.0 END AS score,
    CASE WHEN visual_score BETWEEN -1 AND 1 THEN visual_score END AS visual_score,
    CASE WHEN siglip_score BETWEEN -1 AND 1 THEN siglip_score END AS siglip_score,
    CASE WHEN dino_score BETWEEN -1 AND 1 THEN dino_score END AS dino_score,
    CASE WHEN ocr_score BETWEEN -1 AND 1 THEN ocr_score END AS ocr_score
  FROM search_candidates WHERE search_id IS NOT NULL)"""
HIT_ROWS = f"{HITS}, rows AS (SELECT query_id, sku, image_id, family, score FROM h WHERE sku IS NOT NULL)"


@query("sku_max_aggregate", f"WITH {HIT_ROWS}, {_SKUS} SELECT query_id, sku, rank::int AS rank, round(score, 6) AS score, matched_images FROM skr")
def sku_max_aggregate(spark, d):
    rows = S.aggregate_skus(R.sku_hits(table(spark, d, "search_candidates")))
    return rows.select("query_id", "sku", "rank", F.round("score", 6).alias("score"), "matched_images")


@query("weighted_multi_model_score", f"WITH {HITS} SELECT candidate_id, CASE WHEN siglip_score IS NOT NULL OR dino_score IS NOT NULL THEN round(greatest(-1, least(1, (coalesce(siglip_score * 0.35, 0) + coalesce(dino_score * 0.65, 0)) / nullif(CASE WHEN siglip_score IS NULL THEN 0 ELSE 0.35::double END + CASE WHEN dino_score IS NULL THEN 0 ELSE 0.65::double END, 0))), 6) END AS visual FROM h")
def weighted_multi_model_score(spark, d):
    hits = R.hits(table(spark, d, "search_candidates"))
    return hits.select("candidate_id", F.round(V.clip(V.weighted_mean([(F.col("siglip_score"), 0.35), (F.col("dino_score"), 0.65)])), 6).alias("visual"))


@query("secondary_fusion", f"WITH {HITS} SELECT candidate_id, round(CASE WHEN ocr_score IS NULL THEN visual_score ELSE greatest(-1, least(1, (1 - 0.3) * visual_score + 0.3 * ocr_score)) END, 6) AS final FROM h")
def secondary_fusion(spark, d):
    s = Settings(secondary_weight=0.3, description_weight=0.4)
    secondary = S.secondary_score(F.lit(None).cast("double"), F.col("ocr_score"), s.description_weight)
    return R.hits(table(spark, d, "search_candidates")).select("candidate_id", F.round(S.final_score(F.col("visual_score"), secondary, s), 6).alias("final"))


def _decision(spark, d, s: Settings) -> DataFrame:
    return S.decide(S.aggregate_skus(R.sku_hits(table(spark, d, "search_candidates"))), s)


@query("confidence_level", f"WITH {HIT_ROWS}, {_SKUS}, {_decide()} SELECT query_id, confidence, round(score_gap, 6) AS score_gap FROM d")
def confidence_level(spark, d):
    return _decision(spark, d, SETTINGS).select("query_id", "confidence", F.round("score_gap", 6).alias("score_gap"))


@query("ambiguity_flag", f"WITH {HIT_ROWS}, {_SKUS}, {_decide()} SELECT query_id, ambiguous, reason, alternatives FROM d")
def ambiguity_flag(spark, d):
    return _decision(spark, d, SETTINGS).select("query_id", "ambiguous", "reason", "alternatives")


@query("policy_gate", f"WITH {HIT_ROWS}, {_SKUS}, {_decide('0.706')} SELECT query_id, kept, confidence, ambiguous FROM d")
def policy_gate(spark, d):
    return _decision(spark, d, Settings(threshold=0.706)).select("query_id", "kept", "confidence", "ambiguous")


@query("hit_top5", f"WITH {HIT_ROWS}, {_SKUS} SELECT query_id, sku, rank::int AS rank FROM skr WHERE rank <= 5")
def hit_top5(spark, d):
    return S.aggregate_skus(R.sku_hits(table(spark, d, "search_candidates"))).where("rank <= 5").select("query_id", "sku", "rank")


@query("display_filter", f"WITH {HIT_ROWS}, {_SKUS} SELECT query_id, max(sku) FILTER (rank = 1) AS predicted_sku, count(*) FILTER (score >= 0.72) AS shown FROM skr GROUP BY 1")
def display_filter(spark, d):
    rows = S.aggregate_skus(R.sku_hits(table(spark, d, "search_candidates")))
    return rows.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("sku"))).alias("predicted_sku"), F.count_if(F.col("score") >= 0.72).alias("shown"))


@query("response_contract", f"""WITH {HIT_ROWS}, {_SKUS}
SELECT query_id, count(*) FILTER (rank <= 5) AS rows, count(*) FILTER (score > 1.000001) AS too_high, count(*) FILTER (len(string_split(evidence, ',')) <> matched_images) AS evidence_mismatch FROM (SELECT * REPLACE (coalesce(evidence, '') AS evidence) FROM skr) WHERE true GROUP BY 1""")
def response_contract(spark, d):
    rows = S.aggregate_skus(R.sku_hits(table(spark, d, "search_candidates")))
    listed = F.greatest(F.lit(1), F.size(F.filter("matched_image_ids", lambda x: x.isNotNull())))
    return rows.groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("rows"), F.count_if(F.col("score") > 1.000001).alias("too_high"), F.count_if(listed != F.col("matched_images")).alias("evidence_mismatch"))
