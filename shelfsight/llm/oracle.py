"""SQL (DuckDB) that must return what the queries return."""

ORACLE: dict[str, str] = {}

_NEAR = """
ok AS (
  SELECT vector_id, lower(trim(embedding_type)) || chr(31) || lower(trim(crop_type)) AS g, list_transform(value, lambda x: x::double) AS v
  FROM vectors WHERE ref_id IN (SELECT ref_id FROM refs) AND value IS NOT NULL AND len(value) = dimension
    AND len(list_filter(value, lambda x: NOT isfinite(x) OR x IS NULL)) = 0 AND len(list_filter(value, lambda x: x <> 0)) > 0
),
sim AS (
  SELECT a.vector_id, b.vector_id AS neighbour, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
  FROM ok a JOIN ok b ON a.g = b.g AND a.vector_id <> b.vector_id AND len(a.v) = len(b.v)
),
lists AS (
  SELECT * FROM sim WHERE similarity >= 0.9
  QUALIFY row_number() OVER (PARTITION BY vector_id ORDER BY similarity DESC, neighbour) <= 5
)
"""
ORACLE["p1_lists"] = f"WITH {_NEAR} SELECT vector_id, neighbour, similarity FROM lists"
ORACLE["p1_found"] = f"WITH {_NEAR} SELECT DISTINCT least(vector_id, neighbour) AS vector_a, greatest(vector_id, neighbour) AS vector_b FROM lists"

ORACLE["p2_found"] = """
WITH hits AS (SELECT DISTINCT candidate_id, image_id, score FROM search_candidates WHERE score IS NOT NULL AND NOT isnan(score) AND score BETWEEN -1 AND 1),
img AS (SELECT DISTINCT image_id, upper(trim(sku)) AS sku FROM refs WHERE sku IS NOT NULL)
SELECT sku, candidate_id FROM hits JOIN img USING (image_id)
QUALIFY row_number() OVER (PARTITION BY sku ORDER BY score DESC, image_id, candidate_id) <= 5
"""

_CLEAN = """
CASE WHEN regexp_full_match(lower(trim(photo_hash)), '[0-9a-f]{64}') THEN lower(trim(photo_hash)) END AS h,
CASE WHEN regexp_full_match(lower(trim(dhash)), '[0-9a-f]{16}') AND lower(trim(dhash)) <> '0000000000000000' THEN ('0x' || lower(trim(dhash)))::UBIGINT END AS d
"""
_GROUP = "CASE WHEN lower(trim(capture_group)) NOT IN ('', 'unknown-session') THEN lower(trim(capture_group)) END AS g"
_PAIRS = f"""
e AS (SELECT DISTINCT eval_id, {_CLEAN}, {_GROUP} FROM evaluation),
f AS (SELECT DISTINCT feedback_id, {_CLEAN}, {_GROUP} FROM feedback_preview WHERE lower(trim(training_status)) = 'exported'),
pairs AS (
  SELECT eval_id, feedback_id, coalesce(e.h = f.h, false) AS same_hash, coalesce(bit_count(xor(e.d, f.d)) <= 4, false) AS near_hash, coalesce(e.g = f.g, false) AS same_group
  FROM e, f WHERE e.h = f.h OR e.g = f.g OR bit_count(xor(e.d, f.d)) <= 4
)"""
ORACLE["p3_found"] = f"WITH {_PAIRS} SELECT DISTINCT eval_id, feedback_id FROM pairs"
ORACLE["p3_kinds"] = f"WITH {_PAIRS} SELECT eval_id, feedback_id, same_hash, near_hash, same_group FROM pairs"
ORACLE["p3_report"] = f"""
WITH {_PAIRS},
r AS (SELECT eval_id, min((coalesce(lower(trim(split)), 'unknown'), coalesce(lower(trim(source)), 'unknown'))) AS s FROM evaluation GROUP BY 1),
n AS (SELECT eval_id, count(*) AS n FROM pairs GROUP BY 1)
SELECT s[1] AS split, s[2] AS source, count(*) AS records, count(n) AS overlapping, coalesce(sum(n), 0)::bigint AS pairs FROM r LEFT JOIN n USING (eval_id) GROUP BY 1, 2
"""
ORACLE["p3_coverage"] = f"""
WITH {_PAIRS},
r AS (SELECT eval_id, coalesce(max(CASE WHEN h IS NOT NULL THEN 64 END), 0) AS h, coalesce(max(CASE WHEN d IS NOT NULL THEN 16 END), 0) AS d, coalesce(max(length(g)), 0) AS g FROM e GROUP BY 1),
n AS (SELECT eval_id, max(same_hash::int) AS mh, max(near_hash::int) AS md, max(same_group::int) AS mg FROM pairs GROUP BY 1),
x AS (SELECT eval_id, h, d, g, coalesce(mh, 0) AS mh, coalesce(md, 0) AS md, coalesce(mg, 0) AS mg FROM r LEFT JOIN n USING (eval_id))
SELECT eval_id, (h + d + g)::int AS chars, (h * mh + d * md + g * mg)::int AS matched,
  (mh + (md = 1 AND mh = 0)::int + (mg = 1 AND CASE WHEN d > 0 THEN md WHEN h > 0 THEN mh ELSE 0 END = 0)::int)::int AS spans,
  CASE WHEN h + d + g > 0 THEN (h * mh + d * md + g * mg) / (h + d + g) END AS coverage FROM x
"""

ORACLE["p4_found"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT eval_id, {_CLEAN}, {_GROUP} FROM evaluation),
k AS (SELECT eval_id, 'h' || h AS k FROM e WHERE h IS NOT NULL UNION SELECT eval_id, 'g' || g FROM e WHERE g IS NOT NULL),
edge AS (SELECT DISTINCT a.eval_id AS a, b.eval_id AS b FROM k a JOIN k b USING (k)),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
first AS (SELECT a AS eval_id, min(b) AS first_eval_id FROM reach GROUP BY 1)
SELECT first_eval_id, eval_id FROM first WHERE first_eval_id <> eval_id
"""

ORACLE["p4_balance"] = """
WITH r AS (SELECT DISTINCT eval_id FROM evaluation WHERE eval_id IS NOT NULL),
t AS (SELECT DISTINCT eval_id, unnest(tags) AS label FROM evaluation)
SELECT coalesce(label, '(none)') AS label, count(*) AS records, true AS near, true AS whole_sets FROM r LEFT JOIN (SELECT * FROM t WHERE label IS NOT NULL) USING (eval_id) GROUP BY 1
"""

ORACLE["p5_found"] = f"""
WITH RECURSIVE one AS (
  SELECT feedback_id, batch_no, {_CLEAN} FROM feedback_preview QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY batch_no) = 1
),
known AS (SELECT DISTINCT lower(trim(photo_hash)) AS h FROM refs WHERE regexp_full_match(lower(trim(photo_hash)), '[0-9a-f]{{64}}')),
o AS (SELECT row_number() OVER (ORDER BY batch_no, feedback_id) AS rn, feedback_id, h, d, h IN (SELECT h FROM known) AS old FROM one),
go AS (
  SELECT 0::bigint AS rn, false AS bad, NULL::bigint AS feedback_id, []::varchar[] AS hs, []::ubigint[] AS ds
  UNION ALL
  SELECT rn, bad, feedback_id, CASE WHEN bad OR h IS NULL THEN hs ELSE list_append(hs, h) END, CASE WHEN bad OR d IS NULL THEN ds ELSE list_append(ds, d) END
  FROM (
    SELECT o.rn, o.feedback_id, o.h, o.d, go.hs, go.ds,
      coalesce(o.old, false) OR coalesce(list_contains(go.hs, o.h), false) OR coalesce(len(list_filter(go.ds, lambda x: bit_count(xor(x, o.d)) <= 4)) > 0, false) AS bad
    FROM go JOIN o ON o.rn = go.rn + 1
  )
)
SELECT feedback_id FROM go WHERE bad
"""

ORACLE["p7_found"] = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT id, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
ig AS (SELECT DISTINCT id, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM i))
SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (g)
"""

_SPANS = """
w AS (SELECT doc_id, p AS s, substr(text, p + 1, 240) AS x FROM (SELECT doc_id, text, unnest(range(0, length(text) - 239)) AS p FROM documents WHERE length(text) >= 240)),
c AS (SELECT x FROM w GROUP BY x HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT doc_id, s FROM w WHERE x IN (SELECT x FROM c)),
b AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 240 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM b),
spans AS (SELECT doc_id, min(s)::int AS start_pos, (max(s) + 240)::int AS end_pos FROM g GROUP BY doc_id, n)
"""
ORACLE["p8_found"] = f"WITH {_SPANS} SELECT doc_id, start_pos, end_pos FROM spans"
ORACLE["p8_share"] = f"""
WITH {_SPANS}, t AS (SELECT doc_id, sum(end_pos - start_pos) AS n FROM spans GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0)::int AS n_chars, coalesce(n, 0)::bigint AS shared, CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) END AS share
FROM documents LEFT JOIN t USING (doc_id)
"""
