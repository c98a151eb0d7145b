"""Queries on the catalogue, its references and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import attributes as A
from shelfsight.functions import text as X
from shelfsight.operators import catalog as C
from shelfsight.plans.registry import query
from shelfsight.runtime import table

LATEST = "p AS (SELECT * FROM products WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY updated_at DESC) = 1)"
EARLIEST = "p0 AS (SELECT * FROM products WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY updated_at) = 1)"
REFS = "r AS (SELECT DISTINCT ref_id, image_id, try_cast(product_id AS bigint) AS product_id, upper(trim(sku)) AS sku, indexed_at, photo_hash, representation, extra, lower(trim(category)) AS category FROM refs)"


def _refs(spark, d):
    return table(spark, d, "refs").select("ref_id", "image_id", F.col("product_id").try_cast("bigint").alias("product_id"), F.upper(F.trim("sku")).alias("sku"), "indexed_at", "photo_hash", "representation", "extra", F.lower(F.trim("category")).alias("category")).distinct()


def _products(spark, d):
    return C.latest_products(table(spark, d, "products"))


@query("catalog_text_search", f"WITH {LATEST} SELECT product_id, sku FROM p WHERE (lower(sku) LIKE '%kn%' OR lower(description) LIKE '%kn%') AND (lower(sku) LIKE '%kunci%' OR lower(description) LIKE '%kunci%')")
def catalog_text_search(spark, d):
    return C.search_text(_products(spark, d), "KN  kunci").select("product_id", "sku")


@query("document_text_search", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%padlock%' AND lower(text) LIKE '%yellow%'")
def document_text_search(spark, d):
    return table(spark, d, "documents").where(X.matches_terms("Padlock yellow", "text")).select("doc_id")


@query("catalog_inner_join_photos", f"WITH {LATEST}, {REFS} SELECT p.product_id, p.sku, count(*) AS images, count(DISTINCT r.representation) AS kinds FROM p JOIN r USING (product_id) GROUP BY 1, 2")
def catalog_inner_join_photos(spark, d):
    return _products(spark, d).select("product_id", "sku").join(_refs(spark, d).select("product_id", "representation"), "product_id").groupBy("product_id", "sku").agg(F.count("*").alias("images"), F.count_distinct("representation").alias("kinds"))


@query("catalog_semi_join_has_photo", f"WITH {LATEST}, {REFS} SELECT product_id, sku FROM p WHERE product_id IN (SELECT product_id FROM r)")
def catalog_semi_join_has_photo(spark, d):
    return _products(spark, d).join(_refs(spark, d).select("product_id"), "product_id", "left_semi").select("product_id", "sku")


@query("catalog_anti_join_no_photo", f"WITH {LATEST}, {REFS} SELECT product_id, sku FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.product_id = p.product_id)")
def catalog_anti_join_no_photo(spark, d):
    return _products(spark, d).join(_refs(spark, d).select("product_id"), "product_id", "left_anti").select("product_id", "sku")


@query("latest_photo_per_product", f"WITH {REFS} SELECT product_id, ref_id, image_id FROM r WHERE product_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY indexed_at DESC, ref_id DESC) = 1")
def latest_photo_per_product(spark, d):
    return C.first_or_last(_refs(spark, d).select("product_id", "indexed_at", "ref_id", "image_id"), ["product_id"], ["indexed_at", "ref_id"]).select("product_id", "ref_id", "image_id")


@query("catalog_page", f"WITH {LATEST} SELECT product_id, sku, (SELECT count(*) FROM p) AS total FROM p ORDER BY created_at DESC, product_id DESC LIMIT 12 OFFSET 12")
def catalog_page(spark, d):
    p = _products(spark, d)
    return C.page(p, [F.desc("created_at"), F.desc("product_id")], 2).select("product_id", "sku", F.lit(p.count()).alias("total"))


@query("catalog_admin_counts", f"WITH {LATEST}, {REFS} SELECT count(*) AS products, count(*) FILTER (photo IS NULL) AS no_photo, count(*) FILTER (coalesce(trim(description), '') = '') AS no_text, count(*) FILTER (product_id IN (SELECT product_id FROM r WHERE product_id IS NOT NULL)) AS indexed, max(product_id) AS high_water FROM p")
def catalog_admin_counts(spark, d):
    seen = _refs(spark, d).where("product_id IS NOT NULL").select("product_id", F.lit(True).alias("seen")).distinct()
    return _products(spark, d).join(seen, "product_id", "left").agg(F.count("*").alias("products"), F.count_if(F.col("photo").isNull()).alias("no_photo"), F.count_if(F.coalesce(F.trim("description"), F.lit("")) == "").alias("no_text"), F.count_if("seen").alias("indexed"), F.max("product_id").alias("high_water"))


@query("import_diff", f"WITH {LATEST}, {EARLIEST} SELECT product_id, CASE WHEN p0.description IS NOT DISTINCT FROM p.description AND p0.sku IS NOT DISTINCT FROM p.sku AND p0.category IS NOT DISTINCT FROM p.category THEN 'unchanged' ELSE 'changed' END AS change FROM p JOIN p0 USING (product_id)")
def import_diff(spark, d):
    raw = table(spark, d, "products")
    return C.classify(C.earliest_products(raw), C.latest_products(raw), "product_id", ["sku", "description", "category"])


@query("import_upsert_result", f"""WITH {EARLIEST}, i AS (SELECT trim(sku) AS sku, coalesce(description, '') AS d, updated_at AS t FROM products WHERE trim(sku) <> '' QUALIFY row_number() OVER (PARTITION BY trim(sku) ORDER BY updated_at DESC, coalesce(description, '') DESC) = 1)
SELECT sku, CASE WHEN p0.description IS NOT DISTINCT FROM i.d THEN p0.description ELSE i.d END AS description, CASE WHEN p0.description IS NOT DISTINCT FROM i.d THEN 'unchanged' ELSE 'updated' END AS change FROM (SELECT trim(sku) AS sku, description FROM p0) p0 JOIN i USING (sku)""")
def import_upsert_result(spark, d):
    raw = table(spark, d, "products")
    current = C.earliest_products(raw).select(F.trim("sku").alias("sku"), "description", "updated_at")
    return C.upsert(current, C.import_rows(raw, "updated_at")).select("sku", "description", "change")


@query("user_import_first_wins", "SELECT lower(c_mktsegment) || '-' || c_nationkey AS key, min(c_custkey) AS first_id, count(*) - 1 AS skipped FROM customer GROUP BY 1")
def user_import_first_wins(spark, d):
    rows = table(spark, d, "customer").select(F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("key"), "c_custkey")
    return rows.groupBy("key").agg(F.min("c_custkey").alias("first_id"), (F.count("*") - 1).alias("skipped"))


# RE2 has no look-ahead: the measurement rule is compared through its quote branch and a following non-word character.
_UNIT = r"MM|CM|M|INCH|IN"
_NUM = r"\d+(?:[.,]\d+)?"


def _sql_rules(text: str) -> str:
    """(key, upper-case match) rows of the rules that RE2 can express."""
    rows = []
    for key, pattern in A.PATTERNS:
        if key != "measurement":
            p = pattern.replace("'", "''")
            rows.append(f"SELECT id, '{key}' AS key, unnest(regexp_extract_all(t, '(?i){p}')) AS raw FROM {text}")
    return " UNION ALL ".join(rows)


_NORMAL_SQL = r"""
CASE key WHEN 'drive' THEN CASE WHEN upper(raw) IN ('PLUS','PHILLIPS','PHILIPS','CROSS','KEMBANG') THEN 'PHILLIPS' WHEN upper(raw) IN ('MINUS','FLAT','FLATHEAD','SLOTTED') THEN 'FLAT' ELSE upper(raw) END
WHEN 'length' THEN CASE upper(raw) WHEN 'PANJANG' THEN 'LONG' WHEN 'PENDEK' THEN 'SHORT' ELSE upper(raw) END
WHEN 'dimension' THEN regexp_replace(translate(replace(regexp_replace(upper(raw), '\s+', '', 'g'), ',', '.'), '×*', 'XX'), '[''’]$', '"')
ELSE replace(regexp_replace(upper(raw), '\s+', '', 'g'), ',', '.') END"""


@query("attribute_parse", f"WITH {LATEST}, t AS (SELECT product_id AS id, coalesce(description, '') AS t FROM p), m AS ({_sql_rules('t')}) SELECT id AS product_id, key, {_NORMAL_SQL} AS value, count(*) AS n FROM m GROUP BY 1, 2, 3")
def attribute_parse(spark, d):
    rows = _products(spark, d).select("product_id", F.explode(A.parse("description")).alias("a")).where("a.key <> 'measurement'")
    return rows.groupBy("product_id", F.col("a.key").alias("key"), F.col("a.value").alias("value")).agg(F.count("*").alias("n"))


# RE2 has no look-ahead, so the character behind a unit is matched and cut off again.
_UNIT_SQL = r"\b\d+(?:[.,]\d+)?\s*(?:MM|CM|M|INCH|IN)(?:\W|$)|\b\d+(?:[.,]\d+)?\s*[\"″''’]"


@query("attribute_measurements", f"""WITH {LATEST}, m AS (SELECT product_id, unnest(regexp_extract_all(coalesce(description, ''), '(?i){_UNIT_SQL}')) AS raw FROM p),
u AS (SELECT product_id, regexp_replace(raw, '(?i)(MM|CM|M|INCH|IN)\\W$', '\\1') AS raw FROM m)
SELECT DISTINCT product_id, regexp_replace(replace(regexp_replace(upper(raw), '\\s+', '', 'g'), ',', '.'), '[''’]$', '"') AS value FROM u""")
def attribute_measurements(spark, d):
    rows = _products(spark, d).select("product_id", F.explode(A.parse("description")).alias("a")).where("a.key = 'measurement'")
    return rows.select("product_id", F.col("a.value").alias("value")).distinct()


@query("attribute_distinct", f"WITH {LATEST}, t AS (SELECT product_id AS id, coalesce(description, '') AS t FROM p), m AS ({_sql_rules('t')}), v AS (SELECT DISTINCT id, key, {_NORMAL_SQL} AS value FROM m) SELECT key, count(DISTINCT id) AS products, count(DISTINCT value) AS distinct_values FROM v GROUP BY 1")
def attribute_distinct(spark, d):
    rows = C.attribute_rows(_products(spark, d), "product_id", "description").where("key <> 'measurement'")
    return rows.groupBy("key").agg(F.count_distinct("product_id").alias("products"), F.count_distinct("value").alias("distinct_values"))


# attribute_parse and attribute_distinct leave out the key that RE2 cannot express; these two have all keys.
@query("attribute_parse_all")
def attribute_parse_all(spark, d):
    rows = _products(spark, d).select("product_id", F.explode(A.parse("description")).alias("a"))
    return rows.groupBy("product_id", F.col("a.key").alias("key"), F.col("a.value").alias("value")).agg(F.count("*").alias("n"))


@query("attribute_distinct_all")
def attribute_distinct_all(spark, d):
    rows = C.attribute_rows(_products(spark, d), "product_id", "description")
    return rows.groupBy("key").agg(F.count_distinct("product_id").alias("products"), F.count_distinct("value").alias("distinct_values"))


@query("attribute_colors_of_documents", f"WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents) SELECT upper(c) AS color, count(*) AS n, count(DISTINCT id) AS documents FROM (SELECT id, unnest(regexp_extract_all(t, '(?i){dict(A.PATTERNS)['color']}')) AS c FROM t) GROUP BY 1")
def attribute_colors_of_documents(spark, d):
    rule = A.RULES.only("color")
    rows = table(spark, d, "documents").select("doc_id", F.explode(A.parse("text", rule)).alias("a"))
    return rows.groupBy(F.col("a.value").alias("color")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


_VALUES = f"v AS (SELECT DISTINCT id, key, {_NORMAL_SQL} AS value FROM m WHERE key <> 'model')"


@query("attribute_jaccard_compat", f"""WITH {LATEST}, {EARLIEST}, t AS (SELECT product_id * 2 AS id, coalesce(description, '') AS t FROM p UNION ALL SELECT product_id * 2 + 1, coalesce(description, '') FROM p0), m AS ({_sql_rules('t')}), {_VALUES},
l AS (SELECT id, key, list(value) AS vs FROM v GROUP BY 1, 2), j AS (SELECT a.id // 2 AS product_id, key, len(list_intersect(a.vs, b.vs)) / len(list_distinct(list_concat(a.vs, b.vs))) AS s FROM l a JOIN l b USING (key) WHERE a.id % 2 = 0 AND b.id = a.id + 1 AND key <> 'drive')
SELECT product_id, round(avg(s), 6) AS compatibility FROM j GROUP BY 1""")
def attribute_jaccard_compat(spark, d):
    raw = table(spark, d, "products")
    rules = A.RULES.without("measurement", "model", "drive")
    a, b = (df.select("product_id", A.values("description", rules).alias(n)) for df, n in ((C.latest_products(raw), "a"), (C.earliest_products(raw), "b")))
    return a.join(b, "product_id").select("product_id", F.round(A.compatibility("a", "b"), 6).alias("compatibility")).where("compatibility IS NOT NULL")


# attribute_jaccard_compat is the part that SQL can follow; this is the whole.
@query("attribute_compatibility")
def attribute_compatibility(spark, d):
    raw = table(spark, d, "products")
    a, b = (df.select("product_id", A.values("description").alias(n)) for df, n in ((C.latest_products(raw), "a"), (C.earliest_products(raw), "b")))
    return a.join(b, "product_id").select("product_id", F.round(A.compatibility("a", "b"), 6).alias("compatibility")).where("compatibility IS NOT NULL")


_DRIVES = ("PH2", "plus", "Minus", "PZ1", "TORX", "Phillips PZ3", "flat")
_DRIVE_FORM = "CASE WHEN x IN ('PLUS','PHILLIPS','PHILIPS','CROSS','KEMBANG') THEN 'PHILLIPS' WHEN x IN ('MINUS','FLAT','FLATHEAD','SLOTTED') THEN 'FLAT' ELSE x END"


@query("drive_family_compat", f"""WITH {LATEST}, t AS (SELECT product_id, regexp_extract_all(coalesce(description, '') || ' ' || {list(_DRIVES)}[product_id % 7 + 1], '(?i){dict(A.PATTERNS)['drive']}') AS raw FROM p),
v AS (SELECT product_id, list_distinct(list_transform(raw, lambda r: list_transform([upper(r)], lambda x: {_DRIVE_FORM})[1])) AS vs FROM t),
f AS (SELECT *, list_distinct(list_transform(vs, lambda x: CASE WHEN x LIKE 'PH%' THEN 'philips' WHEN x = 'FLAT' THEN 'flat' WHEN x LIKE 'PZ%' THEN 'pozidrive' ELSE 'torx' END)) AS fs FROM v)
SELECT a.product_id, CASE WHEN len(list_intersect(a.vs, b.vs)) > 0 THEN len(list_intersect(a.vs, b.vs)) / len(list_distinct(list_concat(a.vs, b.vs))) WHEN len(list_intersect(a.fs, b.fs)) > 0 THEN 0.5 ELSE 0.0 END AS score
FROM f a JOIN f b ON b.product_id = a.product_id + 1""")
def drive_family_compat(spark, d):
    """Of each product and the next one: the score of their drives; as the goods name none, a drive by the id is added to each description."""
    drive = F.element_at(F.array(*(F.lit(w) for w in _DRIVES)), (F.col("product_id") % len(_DRIVES) + 1).cast("int"))
    rows = _products(spark, d).select("product_id", A.values(F.concat_ws(" ", F.coalesce("description", F.lit("")), drive), A.RULES.only("drive"))["drive"].alias("vs"))
    return rows.join(rows.select((F.col("product_id") - 1).alias("product_id"), F.col("vs").alias("other")), "product_id").select("product_id", A.drive_score(F.col("vs"), F.col("other")).alias("score"))


@query("attribute_trusted_override", f"""WITH {LATEST}, t AS (SELECT product_id AS id, coalesce(description, '') AS t FROM p), m AS (SELECT * FROM ({_sql_rules('t')}) WHERE key = 'color'), v AS (SELECT id, list_sort(list_distinct(list(upper(raw)))) AS vs FROM m GROUP BY 1)
SELECT p.product_id, CASE WHEN p.category IS NOT NULL THEN upper(replace(p.category, ' ', '')) ELSE coalesce(array_to_string(v.vs, ','), '') END AS color FROM p LEFT JOIN v ON v.id = p.product_id""")
def attribute_trusted_override(spark, d):
    p = _products(spark, d)
    manual = p.where("category IS NOT NULL").select("product_id", F.lit("color").alias("key"), F.col("category").alias("value"), F.lit("manual").alias("source"))
    color = A.RULES.only("color")
    rows = p.select("product_id", A.values("description", color).alias("parsed")).join(C.trusted_map(manual), "product_id", "left")
    return rows.select("product_id", F.coalesce(F.array_join(F.try_element_at(A.with_trusted(F.col("parsed"), F.col("trusted")), F.lit("color")), ","), F.lit("")).alias("color"))


@query("attribute_refresh", f"""WITH {LATEST}, t AS (SELECT product_id AS id, coalesce(description, '') AS t FROM p), m AS (SELECT * FROM ({_sql_rules('t')}) WHERE key = 'quantity'), v AS (SELECT DISTINCT id, {_NORMAL_SQL} AS value FROM m)
SELECT id AS product_id, 'quantity' AS key, value, 'parser' AS source FROM v UNION SELECT product_id, 'family', family, 'manual' FROM p WHERE family IS NOT NULL""")
def attribute_refresh(spark, d):
    p = _products(spark, d)
    old = p.where("family IS NOT NULL").select("product_id", F.lit("family").alias("key"), F.col("family").alias("value"), F.lit("manual").alias("source"))
    stale = p.select("product_id", F.lit("quantity").alias("key"), F.lit("STALE").alias("value"), F.lit("parser").alias("source"))
    parsed = C.attribute_rows(p, "product_id", "description").where("key = 'quantity'")
    return C.refresh_attributes(old.unionByName(stale), parsed)


@query("reference_limit_per_sku", f"WITH {REFS} SELECT sku, ref_id, row_number() OVER (PARTITION BY sku ORDER BY image_id)::int AS place FROM r WHERE sku IS NOT NULL QUALIFY place <= 3")
def reference_limit_per_sku(spark, d):
    return C.first_per_sku(_refs(spark, d).where("sku IS NOT NULL"), 3).select("sku", "ref_id", "place")


@query("json_extra_extract", "SELECT DISTINCT ref_id, json_extract_string(extra, '$.view') AS view, json_extract(extra, '$.lot')::bigint AS lot FROM refs")
def json_extra_extract(spark, d):
    e = F.from_json("extra", "view string, lot bigint")
    return table(spark, d, "refs").select("ref_id", e["view"].alias("view"), e["lot"].alias("lot")).distinct()


@query("json_props_extract", "SELECT event_id, json_extract(props, '$.k')::bigint AS k FROM events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("image_stem_ids", r"WITH s AS (SELECT DISTINCT image_id, regexp_extract(image_id, '([^/]*?)(\.[^./]*)?$', 1) AS stem, lower(regexp_extract(image_id, '\.([^./]+)$', 1)) AS ext FROM refs) SELECT image_id, stem, CASE WHEN regexp_full_match(stem, '[0-9]{1,18}') THEN stem::bigint END AS number, nullif(CASE WHEN ext = 'jpeg' THEN 'jpg' ELSE ext END, '') AS extension FROM s")
def image_stem_ids(spark, d):
    return table(spark, d, "refs").select("image_id").distinct().select("image_id", X.stem("image_id").alias("stem"), X.numeric_stem("image_id").alias("number"), X.extension("image_id").alias("extension"))


@query("metadata_precedence", f"WITH {LATEST}, {REFS} SELECT r.ref_id, coalesce(json_extract_string(r.extra, '$.category'), r.category, p.category, 'unknown') AS category FROM r LEFT JOIN p ON p.product_id = r.product_id")
def metadata_precedence(spark, d):
    p = _products(spark, d).select("product_id", F.col("category").alias("own"))
    return _refs(spark, d).join(p, "product_id", "left").select("ref_id", F.coalesce(F.get_json_object("extra", "$.category"), "category", "own", F.lit("unknown")).alias("category"))


@query("cover_photo_resolution", f"""WITH {REFS}, c AS (SELECT DISTINCT candidate_id, search_id, try_cast(product_id AS bigint) AS product_id, image_id, CASE WHEN score BETWEEN -1 AND 1 THEN round(score, 9) END AS score FROM search_candidates),
k AS (SELECT search_id AS query_id, product_id, image_id, row_number() OVER (PARTITION BY search_id, product_id ORDER BY score DESC, image_id, candidate_id) AS pos FROM c WHERE product_id IS NOT NULL AND image_id IS NOT NULL AND score IS NOT NULL),
o AS (SELECT DISTINCT product_id, image_id FROM r WHERE product_id IS NOT NULL AND image_id IS NOT NULL), f AS (SELECT query_id, product_id, arg_min(image_id, pos) AS hit FROM k JOIN o USING (product_id, image_id) GROUP BY 1, 2), a AS (SELECT product_id, min(image_id) AS other FROM o GROUP BY 1)
SELECT DISTINCT query_id, product_id, coalesce(hit, other) AS image_id FROM (SELECT DISTINCT query_id, product_id FROM k) LEFT JOIN f USING (query_id, product_id) LEFT JOIN a USING (product_id)""")
def cover_photo_resolution(spark, d):
    score = F.when(~F.isnan("score") & F.col("score").between(-1, 1), F.round("score", 9))
    rows = table(spark, d, "search_candidates").select("candidate_id", F.col("search_id").alias("query_id"), F.col("product_id").try_cast("bigint").alias("product_id"), "image_id", score.alias("score")).distinct()
    ids = rows.where("product_id IS NOT NULL AND image_id IS NOT NULL AND score IS NOT NULL").groupBy("query_id", "product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "image_id", "candidate_id"))), lambda x: x["image_id"]).alias("ids"))
    return C.covers(ids, _refs(spark, d))


@query("result_product_join", f"WITH {LATEST} SELECT p.product_id, upper(trim(p.sku)) AS sku, count(DISTINCT candidate_id) AS hits FROM search_candidates c JOIN p ON upper(trim(c.sku)) = upper(trim(p.sku)) GROUP BY 1, 2")
def result_product_join(spark, d):
    p = _products(spark, d).select("product_id", F.upper(F.trim("sku")).alias("sku"))
    hits = table(spark, d, "search_candidates").select("candidate_id", F.upper(F.trim("sku")).alias("sku")).distinct()
    # hits are counted per sku first, so a sku with a large share is one row in the join
    return hits.groupBy("sku").agg(F.count("*").alias("hits")).join(p, "sku").select("product_id", "sku", "hits")


@query("label_still_current", f"WITH {LATEST} SELECT count(*) AS records, count(*) FILTER (p.product_id IS NULL) AS no_product, count(*) FILTER (upper(trim(p.sku)) = upper(trim(f.confirmed_sku))) AS current FROM (SELECT DISTINCT feedback_id, confirmed_product_id, confirmed_sku FROM feedback_preview) f LEFT JOIN p ON p.product_id = f.confirmed_product_id")
def label_still_current(spark, d):
    f = table(spark, d, "feedback_preview").select("feedback_id", "confirmed_product_id", F.upper(F.trim("confirmed_sku")).alias("label")).distinct()
    p = _products(spark, d).select(F.col("product_id").alias("pid"), F.upper(F.trim("sku")).alias("sku"))
    return f.join(p, F.col("confirmed_product_id") == F.col("pid"), "left").agg(F.count("*").alias("records"), F.count_if(F.col("pid").isNull()).alias("no_product"), F.count_if(F.col("sku") == F.col("label")).alias("current"))


@query("index_counts", f"WITH {REFS} SELECT coalesce(category, 'unknown') AS category, count(*) AS images, count(*) FILTER (lower(trim(representation)) = 'object') AS objects, count(DISTINCT sku) AS skus FROM r GROUP BY 1")
def index_counts(spark, d):
    return _refs(spark, d).groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("images"), F.count_if(F.lower(F.trim("representation")) == "object").alias("objects"), F.count_distinct("sku").alias("skus"))

