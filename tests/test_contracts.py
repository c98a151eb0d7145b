import math

from pyspark.sql import functions as F

from shelfsight.functions import boxes as B
from shelfsight.operators import contracts as K

NAN = float("nan")


def test_quality_reasons(spark):
    rows = [(1, 60.0, 128, 16384, 8.0), (2, 59.9, 127, 16383, 7.9), (3, None, None, None, None), (4, NAN, 128, None, None), (5, float("inf"), 500, None, NAN)]
    df = spark.createDataFrame(rows, "id bigint, blur double, min_side int, crop_pixels int, gray_std double")
    got = {r["id"]: r["r"] for r in df.select("id", K.quality_reasons(*(F.col(c) for c in df.columns[1:])).alias("r")).collect()}
    assert got == {1: [], 2: ["low_blur", "too_small", "object_too_small", "near_blank"], 3: ["missing_blur", "missing_size"], 4: ["missing_blur"], 5: ["missing_blur"]}


def test_candidates(spark):
    rows = [(1, None, "A", "i", 0.5), (2, 0, "A", "", 0.5), (3, 2, "", "i", 0.5), (4, 3, "A" * 256, None, 0.5), (5, 1, "A", "x" * 513, NAN), (6, 1, "A", "i", 1.0000005), (7, 1, "A", "i", None), (8, 1, None, "i", 0.1)]
    df = spark.createDataFrame(rows, "id bigint, rank int, sku string, image string, score double")
    got = {r["id"]: tuple(r["c"]) for r in df.select("id", K.candidate(F.col("rank"), F.lit(9), F.col("sku"), F.col("image"), [F.col("score")]).alias("c")).collect()}
    assert {i for i, c in got.items() if c[0]} == {1, 6, 7} and got[1][1] == 9 and got[2][2] is None and got[5][2] is None


def test_maps_and_budgets(spark):
    df = spark.createDataFrame([(1, {"view": "a", "x": "b"}), (2, {"My_Embedding": "1"}), (3, None), (4, {})], "id bigint, m map<string,string>")
    got = {r["id"]: (r["kept"], r["bad"]) for r in df.select("id", K.present(F.col("m"), ("view",)).alias("kept"), K.forbidden(F.col("m")).alias("bad")).collect()}
    assert got == {1: ({"view": "a"}, False), 2: ({}, True), 3: (None, False), 4: ({}, False)}
    text = spark.createDataFrame([("é" * 2,), ("é" * 3,), (None,)], "t string")
    assert [r[0] for r in text.select(K.within_budget(F.col("t"), 5)).collect()] == [True, False, True]


def test_dense_ids_and_sets(spark):
    df = spark.createDataFrame([(i * 7 % 501, "clash") for i in range(501)], "id bigint, own string").repartition(5)
    assert sorted((r["id"], r["dense_id"]) for r in K.dense_ids(df, "id").collect()) == [(i, i) for i in range(501)]
    assert K.dense_ids(df.where("false"), "id").collect() == []
    parts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (2, "a"), (3, None)], "id bigint, part string")
    assert {r["id"]: (r["missing"], r["extra"]) for r in K.lacking(parts, "id", "part", ("b", "a")).collect()} == {1: ([], []), 2: (["b"], ["c"])}


def test_blobs_come_back(spark):
    df = spark.createDataFrame([(1, [1.5, -0.0, 3e38]), (2, []), (3, None)], "id bigint, v array<float>")
    got = {r["id"]: (r["blob"], r["value"]) for r in K.from_blob(K.to_blob(df, "v"), "blob").collect()}
    assert bytes(got[1][0][:4]) == b"\x00\x00\xc0?" and got[1][1][0] == 1.5 and math.isclose(got[1][1][2], 3e38, rel_tol=1e-6) and got[2] == (b"", []) and got[3] == (None, None)
    bad = spark.createDataFrame([(bytearray(b"abc"),)], "b binary")
    assert K.from_blob(bad, "b").first()["value"] is None


def test_sane_proposals(spark):
    rows = [{"source": None if i % 2 else "s", "score": [0.5, NAN, None][i % 3], "box": {"x": 0.1, "y": 0.1, "width": -0.1 if i == 2 else 0.2, "height": 0.2}} for i in range(7)]
    df = spark.createDataFrame([(rows,), ([],), (None,)], "p array<struct<source:string,score:double,box:struct<x:double,y:double,width:double,height:double>>>")
    a, b, c = (r[0] for r in df.select(K.sane_proposals(F.col("p"), B.is_valid)).collect())
    assert [(x["source"], x["score"]) for x in a] == [("s", 0.5), ("unknown", None), ("unknown", 0.5), ("s", None)] and b == [] and c is None
