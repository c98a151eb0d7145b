"""Operators on small fixtures with hand-computed or brute-force results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import catalog as C
from shelfsight.operators import dataset as D
from shelfsight.operators import dedup, lifecycle, timing
from shelfsight.operators import evaluation as E
from shelfsight.operators import proposals as P
from shelfsight.operators import search as S
from shelfsight.settings import Settings

SKU = "query_id bigint, sku string, image_id string, family string, score double"


def test_sku_aggregation(spark):
    rows = [(1, "SKU123", n, None, s) for n, s in (("catalog", 0.70), ("front", 0.92), ("back", 0.81), ("side", 0.66), ("detail", 0.78))]
    rows += [(2, "MANY", f"v{i}", None, 0.70 - i / 100) for i in range(10)] + [(2, "FEW", "f", None, 0.85)]
    rows += [(3, "A", "a2", None, 0.9), (3, "B", "b1", None, 0.9), (3, "A", "a1", None, 0.9), (3, "B", "b2", None, 0.7), (3, "A", "a3", None, 0.5), (3, "C", None, None, None)]
    got = S.aggregate_skus(spark.createDataFrame(rows, SKU).repartition(3)).orderBy("query_id", "rank").collect()
    assert (got[0]["score"], got[0]["image_id"], got[0]["matched_images"], got[0]["matched_image_ids"]) == (0.92, "front", 5, ["front", "back", "detail", "catalog", "side"])
    assert [(r["sku"], r["score"], r["matched_images"]) for r in got[1:3]] == [("FEW", 0.85, 1), ("MANY", 0.7, 10)]
    assert [(r["sku"], r["image_id"]) for r in got[3:]] == [("A", "a1"), ("B", "b1")]


def decision(spark, rows, **settings):
    skus = S.aggregate_skus(spark.createDataFrame([(1, s, s, f, x) for s, f, x in rows], SKU))
    return S.decide(skus, Settings(**settings)).first()


def test_confidence_and_ambiguity(spark):
    r = decision(spark, [("A39", "swallow", 0.91), ("A40", "swallow", 0.89), ("B", None, 0.70)])
    assert (r["ambiguous"], r["reason"], r["alternatives"]) == (True, "same_family_variants", "A39,A40")
    assert decision(spark, [("A", "swallow", 0.91), ("B", "brush", 0.90)])["reason"] == "near_tie"
    r = decision(spark, [("A", None, 0.91), ("B", None, 0.80)])
    assert (r["ambiguous"], r["alternatives"], r["confidence"]) == (False, "A", "high")
    assert decision(spark, [("A", None, 0.99)])["confidence"] == "medium"  # no runner-up, no gap
    r = decision(spark, [("A", None, 0.91), ("B", None, 0.80)], threshold=0.95)
    assert (r["kept"], r["confidence"], r["ambiguous"]) == (0, "low", False)


def test_cap_is_the_greedy_loop(spark):
    rng = random.Random(1)
    refs = [(i, f"s{rng.randrange(6)}") for i in range(80)]
    fused = [(q, i, round(rng.random(), 2)) for q in range(4) for i, _ in refs]
    got = S.cap_per_sku(spark.createDataFrame(fused, "query_id bigint, ref_id bigint, fused double"), spark.createDataFrame(refs, "ref_id bigint, sku string"), 3, 10)
    sku = dict(refs)
    for q in range(4):
        taken, n = [], {}
        for _, i, _ in sorted((x for x in fused if x[0] == q), key=lambda x: (-x[2], x[1])):
            if n.get(sku[i], 0) < 3 and len(taken) < 10:
                n[sku[i]] = n.get(sku[i], 0) + 1
                taken.append(i)
        assert sorted(r["ref_id"] for r in got.where(F.col("query_id") == q).collect()) == sorted(taken)


def test_top_k_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    rng = random.Random(2)
    v = [(i, (lambda x: [y / math.hypot(*x) for y in x])([rng.gauss(0, 1) for _ in range(5)])) for i in range(40)]
    v += [(100, v[3][1]), (101, v[3][1])]
    refs = spark.createDataFrame(v, "ref_id bigint, value array<double>").repartition(3)
    queries = spark.createDataFrame(v[:10], "query_id bigint, value array<double>")
    got = {(r["query_id"], r["rank"]): r["ref_id"] for r in S.vector_top_k(queries, refs, 4).collect()}
    for q, a in v[:10]:
        best = sorted((i for i, _ in v if i != q), key=lambda i: (-round(sum(x * y for x, y in zip(a, dict(v)[i], strict=True)), 9), i))[:4]
        assert [got[q, k] for k in range(1, 5)] == best
    assert S.vector_top_k(queries.where("false"), refs, 4).collect() == []
    assert S.vector_top_k(queries, refs.where("false"), 4).collect() == []


def judged(spark, seed=None):
    if seed is None:
        queries, results = [(1, ["A"]), (2, [])], [(1, "A", 0.8, 1), (1, "B", 0.5, 2), (2, "B", 0.6, 1)]
    else:
        rng = random.Random(seed)
        queries = [(q, rng.sample("ABCDEF", rng.randrange(3))) for q in range(30)]
        results = [(q, s, rng.randrange(10) / 10, n) for q in range(28) for n, s in enumerate(rng.sample("ABCDEFGH", rng.randrange(8)))]
    a = spark.createDataFrame(queries, "query_id bigint, relevant array<string>")
    return E.judged(spark.createDataFrame(results, "query_id bigint, sku string, score double, pos int"), a)


def test_metrics(spark):
    at = lambda t: E.ratios(E.summed(E.confusion(judged(spark), t))).first()
    assert at(0.5)["fp"] == 2
    r = at(0.9)
    assert (r["fn"], r["tn"], r["positive_rejection"]) == (1, 1, 1.0)


def test_sweep_equals_direct_metrics(spark):
    rows = judged(spark, 7)
    trials = {round(r["threshold"], 9): r for r in E.sweep(rows).collect()}
    assert len(trials) >= 10
    for t, r in trials.items():
        direct = E.ratios(E.summed(E.confusion(rows, r["threshold"]))).first()
        for c in ("tp", "fp", "fn", "tn", "negative", "negative_fp", "rejected", "positive", "f1"):
            assert r[c] == pytest.approx(direct[c]), (t, c)
    best = E.best_trial(E.sweep(rows)).first()
    assert best["f1"] == pytest.approx(max(r["f1"] for r in trials.values()))
    assert E.freeze(E.sweep(rows), 0.123).collect() == []
    assert E.sweep(rows.where("false")).collect() == []


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("n"))
    got = {r["k"]: r["n"] for r in E.running_totals(df, "k", ["n"]).collect()}
    values, total = {r["k"]: r["n"] for r in df.collect()}, 0
    for k in range(999, -1, -1):
        total += values[k]
        assert got[k] == total


def test_digest_ignores_order_and_repeats(spark):
    df = spark.createDataFrame([(i, f"t{i}", None) for i in range(50)], "id bigint, a string, b string")
    one = lambda x: E.digest(x, "id", "a", "b").first()[0]
    assert one(df) == one(df.orderBy(F.desc("id")).union(df.limit(3))) != one(df.where("id < 49"))


def test_catalog(spark):
    rows = [(1, "A1 ", "x", 1), (2, " A1", None, 2), (3, "", "gone", 3), (4, "B", "y", 4)]
    new = C.import_rows(spark.createDataFrame(rows, "row bigint, sku string, description string, updated_at int"), "updated_at")
    assert {(r["sku"], r["description"]) for r in new.collect()} == {("A1", ""), ("B", "y")}
    old = spark.createDataFrame([("A1", None, 0), ("B", "y", 0), ("C", "z", 0)], "sku string, description string, updated_at int")
    got = {r["sku"]: (r["description"], r["updated_at"], r["change"]) for r in C.upsert(old, new).collect()}
    assert got == {"A1": ("", 2, "updated"), "B": ("y", 0, "unchanged"), "C": ("z", 0, "unchanged")}
    change = {r["sku"]: r["change"] for r in C.classify(old, new, "sku", ["description"]).collect()}
    assert change == {"A1": "changed", "B": "unchanged", "C": "deleted"}
    p = spark.createDataFrame([("K-1", "Kunci 50% off"), ("K-2", None)], "sku string, description string")
    find = lambda q: [r["sku"] for r in C.search_text(p, q).orderBy("sku").collect()]
    assert (find("KUNCI k-1"), find("k-"), find(""), find("50%f")) == (["K-1"], ["K-1", "K-2"], ["K-1", "K-2"], ["K-1"])


def test_covers(spark):
    c = spark.createDataFrame([(1, 10, ["x", "b", "a"]), (2, 10, ["x"]), (3, 11, ["a"])], "query_id bigint, product_id bigint, ids array<string>")
    images = spark.createDataFrame([(10, "a"), (10, "b"), (None, "x")], "product_id bigint, image_id string")
    assert {r["query_id"]: r["image_id"] for r in C.covers(c, images).collect()} == {1: "b", 2: "a", 3: None}


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(150):
        code = rng.choice(base)
        for _ in range(rng.choice([0, 0, 2, 4, 6])):
            code ^= 1 << rng.randrange(64)
        rows.append((i, rng.randrange(3), None, rng.choice([f"{code:016x}", None, "0" * 16])))
    df = dedup.keyed(spark.createDataFrame(rows, "id bigint, product bigint, photo_hash string, dhash string"), "id", "product")
    got = {r["record"]: (r["near"], r["distance"]) for r in dedup.first_near(df).collect()}
    good = [(i, p, int(d, 16)) for i, p, _, d in rows if d and d != "0" * 16]
    expected = {}
    for i, p, c in good:
        for j, q, e in good:
            if j < i and p == q and (c ^ e).bit_count() <= 4:
                expected[i] = (j, (c ^ e).bit_count())
                break
    assert got == expected


def test_duplicate_decision(spark):
    h = "a" * 64
    rows = [(1, 1, h, "0" * 15 + "1"), (2, 2, h.upper(), "f" * 16), (3, 1, None, "03" + "0" * 13 + "1"), (4, 1, None, None)]
    df = dedup.keyed(spark.createDataFrame(rows, "id bigint, product bigint, photo_hash string, dhash string"), "id", "product")
    assert {r["record"]: (r["decision"], r["other"], r["distance"]) for r in dedup.decide(df).collect()} == {1: ("unique", None, None), 2: ("exact", 1, 0), 3: ("near", 1, 2), 4: ("unique", None, None)}


def test_hash_split_is_the_documented_formula(spark):
    import hashlib

    df = spark.range(300).select(F.concat(F.lit("g"), "id").alias("k")).select("k", D.hash_split(F.col("k"), 7, 0.2, 0.1).alias("s"))
    for r in df.collect():
        b = int(hashlib.sha256(f"7\n{r['k']}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
        assert r["s"] == ("test" if b < 0.1 else "validation" if b < 0.1 + 0.2 else "train")


def test_lifecycle(spark):
    j = spark.createDataFrame([('{"a":1,"b":2}', '{"b":2, "a":1}'), (None, None), ('{"a":1}', None)], "x string, y string")
    assert [r[0] for r in j.select(lifecycle.same_json("x", "y")).collect()] == [True, True, False]
    g = spark.createDataFrame([(f"g{i}", f"2026-01-0{i + 1} 00:00:00", None, i == 2, 1 << 20) for i in range(6)], "name string, m string, s string, is_current boolean, size bigint")
    g = g.select("name", F.col("m").cast("timestamp").alias("mtime"), F.col("s").cast("timestamp").alias("superseded_at"), "is_current", "size")
    now = F.lit("2026-02-01").cast("timestamp")
    plan = lifecycle.retention(g, now, keep=2)
    assert {r["name"]: r["reason"] for r in plan.collect()} == {"g0": "expired", "g1": "expired", "g2": "current", "g3": "expired", "g4": "newest", "g5": "newest"}
    assert lifecycle.reclaimable(plan).first()["megabytes"] == 3.0
    assert lifecycle.retention(g.withColumn("is_current", F.lit(False)), now, keep=2).where("NOT kept").count() == 0
    assert {r[0] for r in lifecycle.confirmed_removals(plan, plan.where("name <> 'g1'")).collect()} == {"g0", "g3"}


def test_pairs_within(spark):
    t = lambda s: f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    mk = lambda rows: spark.createDataFrame([(i, u, t(s)) for i, u, s in rows], "id bigint, u bigint, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    left, right = mk([(1, 1, 0), (2, 1, 890), (3, 2, 0)]), mk([(10, 1, 900), (11, 1, 1800), (12, 2, 901), (13, 3, 5)])
    assert {r[0]: r[1] for r in timing.pair_within(left, right, "u", "id", "t").collect()} == {10: 2}


def box(source, x, y, w, h, image=1):
    return (image, source, float(x), float(y), float(w), float(h), None)


BOXES = "image_id bigint, source string, x double, y double, width double, height double, score double"


def test_proposals(spark):
    rows = [box("grabcut_foreground", 0.2, 0.2, 0.4, 0.5), box("saliency", 0.21, 0.2, 0.4, 0.5), box("contour", 0.7, 0.7, 0.2, 0.2), box("contour", 0, 0, 0.9, 0.9), box("contour", 0.5, 0.5, 0.9, 0.9)]
    df = spark.createDataFrame(rows, BOXES)
    got = P.suppressed(df).orderBy("place").collect()
    assert [r["source"] for r in got] == ["grabcut_foreground", "contour"]
    assert P.ranked(df).count() == 3
    images = spark.createDataFrame([(1,), (2,)], "image_id bigint")
    assert {r["image_id"]: r["reason"] for r in P.chosen(df, images).collect()} == {1: "foreground_proposal", 2: "center_fallback"}
    assert P.suppressed(df.where("false")).collect() == []


def test_attached_parts(spark):
    handle, shaft = (0.3, 0.1, 0.3, 0.3), (0.4, 0.41, 0.1, 0.4)
    images = [
        [handle, shaft],
        [handle, (0.7, 0.41, 0.1, 0.4)],  # beside it
        [handle, (0.4, 0.15, 0.1, 0.1)],  # inside it
        [handle, shaft, (0.4, 0.82, 0.05, 0.1)],  # one part a body
        [handle, (0.32, 0.41, 0.05, 0.2), shaft, (0.0, 0.0, 0.0, 0.0)],  # the first that fits; the invalid one is gone
    ]
    rows = [(i, n, "s" if n else "body", *map(float, b)) for i, boxes in enumerate(images) for n, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "image_id bigint, position int, source string, x double, y double, width double, height double")
    got = {}
    for r in P.merged(df).orderBy("image_id", "position").collect():
        got.setdefault(r["image_id"], []).append((r["source"], r["x"], r["y"], round(r["height"], 6)))
    assert got[0] == [("body", 0.3, 0.1, 0.71)]
    assert [len(got[i]) for i in range(5)] == [1, 2, 2, 2, 2] and got[4][0] == ("body", 0.3, 0.1, 0.51)
    assert P.merged(df.where("false")).collect() == []


def test_larger_box_replaces_its_fragment(spark):
    rows = [(1, "s", 0.3, 0.3, 0.2, 0.2, 0.9), (1, "s", 0.25, 0.25, 0.35, 0.35, 0.5), (1, "s", 0.0, 0.0, 1.0, 1.0, 0.4), (1, "t", 0.3, 0.3, 0.2, 0.2, 0.1)]
    df = spark.createDataFrame(rows, BOXES)
    got = [(r["source"], r["place"], r["width"]) for r in P.own_distinct(df).orderBy("source", "place").collect()]
    assert got == [("s", 1, 0.35), ("s", 2, 1.0), ("t", 1, 0.2)]


def test_failures(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", False)], "image_id bigint, source string, ok boolean")
    assert {r["image_id"]: r["error"] for r in P.failures(df).collect()} == {1: False, 2: True}
    assert P.letterbox(200, 100, 100, 100) == (0, 25, 100, 50)
