"""Queries on boxes, proposals, patches and pixels, derived from the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsight.functions import boxes as B
from shelfsight.functions import images as I
from shelfsight.functions import vectors as V
from shelfsight.operators import proposals as P
from shelfsight.plans.registry import query
from shelfsight.runtime import table

_N = 4


def _sql_boxes() -> str:
    parts = []
    for i in range(_N):
        e = [f"abs(embedding[{4 * i + j + 1}]::double)" for j in range(4)]
        parts.append(f"SELECT vec_id, {i} AS n, least(0.9, {e[0]}) AS x, least(0.9, {e[1]}) AS y, least(1 - least(0.9, {e[0]}), {e[2]} * 3 + 0.02) AS w, least(1 - least(0.9, {e[1]}), {e[3]} * 3 + 0.02) AS h FROM embeddings")
    return "b AS (" + " UNION ALL ".join(parts) + ")"


def _boxes(spark, d):
    e = table(spark, d, "embeddings")

    def box(i):
        a = [F.abs(F.col("embedding")[4 * i + j].cast("double")) for j in range(4)]
        x, y = F.least(F.lit(0.9), a[0]), F.least(F.lit(0.9), a[1])
        return B.make(x, y, F.least(1 - x, a[2] * 3 + 0.02), F.least(1 - y, a[3] * 3 + 0.02))

    return e.select("vec_id", "label", *(box(i).alias(f"b{i}") for i in range(_N)))


_AB = f"WITH {_sql_boxes()}, p AS (SELECT a.vec_id, a.x AS x1, a.y AS y1, a.w AS w1, a.h AS h1, c.x AS x2, c.y AS y2, c.w AS w2, c.h AS h2 FROM b a JOIN b c ON a.vec_id = c.vec_id AND a.n = 0 AND c.n = 1), q AS (SELECT *, greatest(0, least(x1 + w1, x2 + w2) - greatest(x1, x2)) * greatest(0, least(y1 + h1, y2 + h2) - greatest(y1, y2)) AS o FROM p)"


@query("box_iou_pairs", f"{_AB} SELECT vec_id, round(o / (w1 * h1 + w2 * h2 - o), 6) AS iou FROM q")
def box_iou_pairs(spark, d):
    return _boxes(spark, d).select("vec_id", F.round(B.iou(F.col("b0"), F.col("b1")), 6).alias("iou"))


@query("box_containment", f"{_AB} SELECT vec_id, round(o / least(w1 * h1, w2 * h2), 6) AS containment FROM q")
def box_containment(spark, d):
    return _boxes(spark, d).select("vec_id", F.round(B.containment(F.col("b0"), F.col("b1")), 6).alias("containment"))


@query("proportion_compatibility", f"{_AB} SELECT vec_id, round(greatest(0, 1 - abs(ln((greatest(w1, h1) / least(w1, h1)) / (greatest(w2, h2) / least(w2, h2)))) / ln(4)), 6) AS proportion FROM q")
def proportion_compatibility(spark, d):
    return _boxes(spark, d).select("vec_id", F.round(B.proportion(F.col("b0"), F.col("b1")), 6).alias("proportion"))


@query("box_quality", f"""WITH {_sql_boxes()}, s AS (SELECT vec_id, n, CASE WHEN w * h <= 0.3 THEN w * h / 0.3 ELSE (1 - w * h) / 0.7 END AS size, greatest(0, 1 - abs(x + w / 2 - 0.5) - abs(y + h / 2 - 0.5)) AS mid, 1 - least(1, abs(ln(greatest(w, h) / least(w, h) / 1.25)) / 2.8) AS aspect FROM b)
SELECT vec_id, n, round((0.3::double * size + 0.25 * mid + 0.1 * aspect) / 0.65, 6) AS quality FROM s""")
def box_quality(spark, d):
    rows = _boxes(spark, d).select("vec_id", F.posexplode(F.array(*(f"b{i}" for i in range(_N)))).alias("n", "b"))
    return rows.select("vec_id", "n", F.round(B.quality(F.col("b")), 6).alias("quality"))


@query("pixel_crop_roundtrip", f"""WITH {_sql_boxes()}, p AS (SELECT vec_id, n, floor(x * 640)::int AS x, floor(y * 480)::int AS y, (least(640, ceil((x + w) * 640)) - floor(x * 640))::int AS w, (least(480, ceil((y + h) * 480)) - floor(y * 480))::int AS h FROM b)
SELECT vec_id, n, x AS px, y AS py, w AS pw, h AS ph, round(x / 640, 4) AS fx, round(h / 480, 4) AS fh FROM p""")
def pixel_crop_roundtrip(spark, d):
    rows = _boxes(spark, d).select("vec_id", F.posexplode(F.array(*(f"b{i}" for i in range(_N)))).alias("n", "b"))
    size = (F.lit(640), F.lit(480))
    rows = rows.withColumn("p", B.to_pixels(F.col("b"), *size)).withColumn("f", B.to_fractions(F.col("p"), *size))
    return rows.select("vec_id", "n", *(F.col(f"p.{c}").alias(n) for c, n in (("x", "px"), ("y", "py"), ("width", "pw"), ("height", "ph"))), F.col("f.x").alias("fx"), F.col("f.height").alias("fh"))


_SOURCES = ("grabcut_foreground", "saliency", "color_pop", "contour")


def _proposals(spark, d):
    names = F.array(*(F.lit(x) for x in _SOURCES))
    rows = _boxes(spark, d).select(F.col("vec_id").alias("image_id"), F.posexplode(F.array(*(f"b{i}" for i in range(_N)))).alias("position", "b"))
    return rows.select("image_id", "position", F.element_at(names, F.col("position") + 1).alias("source"), "b.x", "b.y", "b.width", "b.height")


def _sql_iou(a: str, b: str) -> str:
    o = _sql_shared(a, b)
    return f"({o} / ({a}.w * {a}.h + {b}.w * {b}.h - {o}))"


def _sql_shared(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


def _sql_contained(a: str, b: str) -> str:
    return f"({_sql_shared(a, b)} / least({a}.w * {a}.h, {b}.w * {b}.h))"


_SQL_PROPOSALS = f"""{_sql_boxes()},
v AS (SELECT vec_id AS image_id, n AS position, CASE n {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SOURCES))} END AS source, x, y, w, h FROM b WHERE w >= 0.01 AND h >= 0.01 AND x + w <= 1.0001 AND y + h <= 1.0001)"""


def _sql_ranked(rows: str) -> str:
    """CTEs up to r (image_id, position, source, x, y, w, h, rank_score) over the proposals of a table."""
    return f"""
g AS (SELECT *, (0.3::double * CASE WHEN w * h <= 0.3 THEN w * h / 0.3 ELSE (1 - w * h) / 0.7 END + 0.25 * greatest(0, 1 - abs(x + w / 2 - 0.5) - abs(y + h / 2 - 0.5)) + 0.1 * (1 - least(1, abs(ln(greatest(w, h) / least(w, h) / 1.25)) / 2.8))) / 0.65 AS quality FROM {rows} WHERE w * h < 0.5),
c AS (SELECT a.image_id, a.position, count(DISTINCT b.source) AS n FROM g a JOIN g b ON a.image_id = b.image_id AND a.source <> b.source AND b.quality >= 0.75 * a.quality AND {_sql_iou("a", "b")} >= 0.5 GROUP BY 1, 2),
r AS (SELECT g.image_id, g.position, source, x, y, w, h, round(quality * CASE source WHEN 'grabcut_foreground' THEN 1.0::double WHEN 'color_pop' THEN 0.85 WHEN 'saliency' THEN 0.7 ELSE 0.6 END * (1 + 0.15::double * least(2, coalesce(n, 0))), 6) AS rank_score FROM g LEFT JOIN c USING (image_id, position)),
l AS (SELECT image_id, list({{'source': source, 'x': x, 'y': y, 'w': w, 'h': h, 'rank_score': rank_score}} ORDER BY rank_score DESC, position) AS bs FROM r GROUP BY 1),
go AS (
  SELECT image_id, bs, 0 AS k, []::int[] AS kept FROM l
  UNION ALL
  SELECT image_id, bs, k + 1, CASE WHEN len(kept) < 5 AND len(list_filter(kept, lambda j: {_sql_iou("bs[j]", "bs[k + 1]")} >= 0.65 OR {_sql_contained("bs[j]", "bs[k + 1]")} > 0.9)) = 0 THEN list_append(kept, k + 1) ELSE kept END
  FROM go WHERE k < len(bs)),
s AS (SELECT image_id, u.place, bs[u.i] AS q FROM (SELECT image_id, bs, unnest(list_transform(kept, lambda i, n: {{'i': i, 'place': n}})) AS u FROM go WHERE k = len(bs)))"""


_SQL_PLACES = "SELECT image_id, place::int AS place, q.source AS source, round(q.x, 6) AS x, round(q.y, 6) AS y, round(q.w, 6) AS width, round(q.h, 6) AS height, q.rank_score AS rank_score FROM s"


def _rounded(df):
    return df.select(*(F.round(c, 6).alias(c) if c in ("x", "y", "width", "height") else c for c in df.columns))


@query("proposal_corroboration", f"WITH RECURSIVE {_SQL_PROPOSALS}, {_sql_ranked('v')} SELECT image_id, source, rank_score FROM r")
def proposal_corroboration(spark, d):
    return P.ranked(_proposals(spark, d)).select("image_id", "source", "rank_score")


@query("proposal_nms", f"WITH RECURSIVE {_SQL_PROPOSALS}, {_sql_ranked('v')} {_SQL_PLACES}")
def proposal_nms(spark, d):
    return _rounded(P.suppressed(_proposals(spark, d)))


def _sql_attaches(a: str, b: str) -> str:
    wide, narrow = f"greatest({a}.w, {b}.w)", f"least({a}.w, {b}.w)"
    jw = f"(greatest({a}.x + {a}.w, {b}.x + {b}.w) - least({a}.x, {b}.x))"
    jh = f"(greatest({a}.y + {a}.h, {b}.y + {b}.h) - least({a}.y, {b}.y))"
    return f"""({narrow} < 0.6 * {wide} AND least({a}.w * {a}.h, {b}.w * {b}.h) < 0.5 * greatest({a}.w * {a}.h, {b}.w * {b}.h)
      AND least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x) >= 0.8 * {narrow} AND {jh} - greatest({a}.h, {b}.h) > 0.005 AND {jw} <= 1.1 * {wide} AND {jw} * {jh} < 0.6
      AND CASE WHEN {a}.y <= {b}.y THEN {b}.y - {a}.y - {a}.h ELSE {a}.y - {b}.y - {b}.h END BETWEEN -0.03 AND 0.05)"""


_SQL_MERGED = f"""{_SQL_PROPOSALS},
m AS (SELECT image_id, list({{'source': source, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY position) AS ps FROM v GROUP BY 1),
pair AS (
  SELECT image_id, ps, 0 AS k, []::bigint[] AS taken, []::struct(a bigint, b bigint)[] AS pairs FROM m
  UNION ALL
  SELECT image_id, ps, k + 1, CASE WHEN list_contains(taken, k + 1) OR j IS NULL THEN taken ELSE list_append(taken, j) END, CASE WHEN list_contains(taken, k + 1) THEN pairs ELSE list_append(pairs, {{'a': (k + 1)::bigint, 'b': j}}) END
  FROM (SELECT *, list_filter(range(k + 2, len(ps) + 1), lambda j: NOT list_contains(taken, j) AND {_sql_attaches("ps[k + 1]", "ps[j]")})[1] AS j FROM pair WHERE k < len(ps))),
u AS (SELECT image_id, p.place AS position, ps[p.q.a] AS a, ps[p.q.b] AS b FROM (SELECT image_id, ps, unnest(list_transform(pairs, lambda q, i: {{'q': q, 'place': i}})) AS p FROM pair WHERE k = len(ps))),
mv AS (SELECT image_id, position, CASE WHEN b IS NOT NULL AND b.w * b.h > a.w * a.h THEN b.source ELSE a.source END AS source, least(a.x, coalesce(b.x, a.x)) AS x, least(a.y, coalesce(b.y, a.y)) AS y,
  CASE WHEN b IS NULL THEN a.w ELSE greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) END AS w, CASE WHEN b IS NULL THEN a.h ELSE greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) END AS h FROM u)"""


@query("attach_merge", f"WITH RECURSIVE {_SQL_MERGED} SELECT image_id, source, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS width, round(h, 6) AS height FROM mv")
def attach_merge(spark, d):
    return _rounded(P.merged(_proposals(spark, d)).drop("position"))


@query("proposal_pipeline", f"WITH RECURSIVE {_SQL_MERGED}, {_sql_ranked('mv')} {_SQL_PLACES}")
def proposal_pipeline(spark, d):
    return _rounded(P.suppressed(P.merged(_proposals(spark, d))))


@query("proposal_choice", f"""WITH RECURSIVE {_SQL_PROPOSALS}, {_sql_ranked('v')}
SELECT i.vec_id AS image_id, CASE WHEN q IS NULL THEN 'center_fallback' ELSE 'foreground_proposal' END AS reason, round(coalesce(q.x, 0.1), 6) AS x, round(coalesce(q.y, 0.1), 6) AS y, round(coalesce(q.w, 0.8), 6) AS width, round(coalesce(q.h, 0.8), 6) AS height
FROM (SELECT DISTINCT vec_id FROM embeddings) i LEFT JOIN s ON i.vec_id = s.image_id AND s.place = 1""")
def proposal_choice(spark, d):
    return _rounded(P.chosen(_proposals(spark, d), _boxes(spark, d).select(F.col("vec_id").alias("image_id"))))


@query("proposal_own_nms", f"""WITH RECURSIVE {_sql_boxes()},
l AS (SELECT vec_id AS image_id, list({{'x': x, 'y': y, 'w': w, 'h': h, 'score': w * h}} ORDER BY w * h DESC, y, x, w, h) AS bs FROM (SELECT vec_id, x, y, round(w / 2 + 0.01, 6) AS w, round(h / 2 + 0.01, 6) AS h FROM b) GROUP BY 1),
go AS (
  SELECT image_id, bs, 0 AS k, []::struct(x double, y double, w double, h double, score double)[] AS kept FROM l
  UNION ALL
  SELECT image_id, bs, k + 1, CASE WHEN hit IS NULL THEN list_append(kept, bs[k + 1]) WHEN hit.wider THEN list_transform(kept, lambda o, i: CASE WHEN i = hit.i THEN bs[k + 1] ELSE o END) ELSE kept END
  FROM (SELECT *, list_filter(list_transform(kept, lambda o, i: CASE WHEN {_sql_iou("o", "bs[k + 1]")} > 0.5 THEN {{'i': i, 'wider': false}}
      WHEN {_sql_contained("o", "bs[k + 1]")} > 0.9 AND greatest(o.w * o.h, bs[k + 1].w * bs[k + 1].h) < 4 * least(o.w * o.h, bs[k + 1].w * bs[k + 1].h) THEN {{'i': i, 'wider': bs[k + 1].w * bs[k + 1].h > o.w * o.h}} END), lambda t: t IS NOT NULL)[1] AS hit FROM go WHERE k < len(bs)))
SELECT image_id, u.i::int AS place, round(u.q.x, 6) AS x, round(u.q.y, 6) AS y, round(u.q.w, 6) AS width, round(u.q.h, 6) AS height FROM (SELECT image_id, unnest(list_transform(kept, lambda q, i: {{'i': i, 'q': q}})) AS u FROM go WHERE k = len(bs))""")
def proposal_own_nms(spark, d):
    half = lambda c: F.round(F.col(c) / 2 + 0.01, 6).alias(c)
    rows = _proposals(spark, d).select("image_id", F.lit("saliency").alias("source"), "x", "y", half("width"), half("height"))
    return _rounded(P.own_distinct(rows.withColumn("score", F.col("width") * F.col("height"))).drop("source", "score"))


_PATCH = "WITH p AS (SELECT vec_id, label, list_transform(range(8), lambda i: list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: x::double)) AS m FROM embeddings), j AS (SELECT a.vec_id, a.m AS a, b.m AS b FROM p a JOIN p b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, list_transform(a, lambda x: list_max(list_transform(b, lambda y: list_dot_product(x, y)))) AS f, list_transform(b, lambda x: list_max(list_transform(a, lambda y: list_dot_product(x, y)))) AS g FROM j)"


def _patches(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("m"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("o")), "vec_id")


@query("patch_similarity", f"{_PATCH} SELECT vec_id, round(greatest(-1, least(1, (list_avg(f) + list_avg(g)) / 2)), 6) AS mean, round(greatest(-1, least(1, (list_avg(list_reverse_sort(f)[1:3]) + list_avg(list_reverse_sort(g)[1:3])) / 2)), 6) AS top_k, round(greatest(-1, least(1, (list_median(f) + list_median(g)) / 2)), 6) AS median, round(greatest(-1, least(1, (list_avg(list_sort(f)[3:6]) + list_avg(list_sort(g)[3:6])) / 2)), 6) AS trimmed FROM d".replace("list_median(f)", "list_aggregate(f, 'median')").replace("list_median(g)", "list_aggregate(g, 'median')"))
def patch_similarity(spark, d):
    s = lambda how, **k: F.round(V.patch_similarity("m", "o", how, **k), 6)
    return _patches(spark, d).select("vec_id", s("mean").alias("mean"), s("top_k", top_k=3).alias("top_k"), s("median").alias("median"), s("trimmed_mean", trim=0.25).alias("trimmed"))


@query("array_even_sample", "SELECT vec_id, round(list_sum(list_transform(range(5), lambda i: embedding[(i * 63) // 4 + 1]::double)), 6) AS total FROM embeddings")
def array_even_sample(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.total(F.transform(V.even_sample("embedding", 5), lambda x: x.cast("double"))), 6).alias("total"))


@query("label_centroid_similarity", """WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM u GROUP BY 1, 2)
SELECT vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 6) AS similarity FROM u JOIN c USING (label, i) GROUP BY 1""")
def label_centroid_similarity(spark, d):
    e = table(spark, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    return e.join(c, "label").select("vec_id", F.round(V.cosine("embedding", "centre"), 6).alias("similarity"))


def _sql_metrics() -> str:
    def small(r: str, c: int) -> str:
        # the weights of the bicubic reduction of 8 to 9 columns, in whole numbers
        taps = [f"{w} * px[8 * {r} + {i + 1}]" for i, w in enumerate(I.cubic_weights(8, 9)[c].tolist()) if w]
        return f"greatest(0, least(255, ({' + '.join(taps)} + {1 << (I.WEIGHT_BITS - 1)}) >> {I.WEIGHT_BITS}))"

    mirror = lambda v: f"(CASE WHEN {v} < 0 THEN 1 WHEN {v} > 7 THEN 6 ELSE {v} END)"
    p = lambda r, c: f"px[8 * {mirror(r)} + {mirror(c)} + 1]"
    row = f"list_transform(range(8), lambda r: [{', '.join(small('r', c) for c in range(9))}])"
    lap = f"list_transform(range(64), lambda i: {p('(i // 8 - 1)', '(i % 8)')} + {p('(i // 8 + 1)', '(i % 8)')} + {p('(i // 8)', '(i % 8 - 1)')} + {p('(i // 8)', '(i % 8 + 1)')} - 4 * px[i + 1])"
    return f"""WITH g AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: greatest(0, least(255, floor((x::double + 1) * 127.5 + 0.5)))::bigint) AS px FROM embeddings),
m AS (SELECT vec_id, px, {row} AS s, {lap} AS l FROM g),
h AS (SELECT vec_id, px, l, list_sum(list_transform(range(64), lambda i: CASE WHEN s[i // 8 + 1][i % 8 + 2] > s[i // 8 + 1][i % 8 + 1] THEN 1::hugeint << i::int ELSE 0::hugeint END))::ubigint AS bits FROM m)
SELECT vec_id, lpad(lower(hex(bits)), 16, '0') AS dhash, round(list_var_pop(l) + 1e-7, 4) AS blur, round(list_stddev_pop(px) + 1e-7, 4) AS gray_std, 64::int AS crop_pixels, 8::int AS min_side FROM h"""


# blur and gray_std are fractions of powers of two, often halfway between two decimals; the addition settles where they go
@query("image_metrics", _sql_metrics())
def image_metrics(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) * 127.5).alias("pixels"), F.lit(8).alias("width"))
    return I.image_metrics(e, "vec_id", "pixels", "width").withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in ("blur", "gray_std")})
