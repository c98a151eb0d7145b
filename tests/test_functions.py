"""Functions against hand-computed values."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.functions import attributes as A
from shelfsight.functions import bits
from shelfsight.functions import boxes as B
from shelfsight.functions import images as I
from shelfsight.functions import text as X
from shelfsight.functions import vectors as V
from shelfsight.settings import Settings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs, kind="array<double>"):
    return F.array(*(F.lit(x) for x in xs)).cast(kind)


def test_normalize(spark):
    assert one(spark, V.normalize(arr(3.0, 4.0))) == [0.6, 0.8]
    for bad in (arr(0.0, 0.0), arr(float("nan"), 1.0), arr(float("inf"), 1.0), arr(), F.lit(None).cast("array<double>")):
        assert one(spark, V.normalize(bad)) is None


def test_cosine_padding_and_clip(spark):
    assert one(spark, V.cosine(arr(1.0, 0.0), arr(2.0, 0.0))) == 1.0
    assert one(spark, V.padded_cosine(arr(1.0, 1.0), arr(1.0))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, V.padded_cosine(arr(1.0), arr(1.0, 5.0))) == 1.0
    assert one(spark, V.padded_cosine(arr(0.0, 0.0), arr(1.0, 1.0))) == 0.0
    assert one(spark, V.clip(F.lit(1.2))) == 1.0 and one(spark, V.clip(F.lit(None).cast("double"))) is None


def test_weighted_mean(spark):
    assert one(spark, V.weighted_mean([(F.lit(0.8), 0.35), (F.lit(0.6), 0.65)])) == pytest.approx(0.67)
    assert one(spark, V.weighted_mean([(F.lit(None).cast("double"), 0.35), (F.lit(0.6), 0.65)])) == pytest.approx(0.6)
    assert one(spark, V.weighted_mean([(F.lit(None).cast("double"), 1.0)])) is None


@pytest.mark.parametrize("how", ["mean", "median", "trimmed_mean", "top_k"])
def test_patches(spark, how):
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda m: (m / np.linalg.norm(m, axis=1, keepdims=True)).tolist())(rng.standard_normal((n, 6)))
    df = spark.createDataFrame([(unit(8), unit(12), unit(3))], "a array<array<double>>, b array<array<double>>, c array<array<double>>")
    r = df.select(V.patch_similarity("a", "a", how).alias("self"), V.patch_similarity("a", "b", how).alias("ab"), V.patch_similarity("b", "a", how).alias("ba"), V.patch_similarity("a", "c", how).alias("few")).first()
    assert r["self"] == pytest.approx(1) and r["ab"] == pytest.approx(r["ba"]) and r["few"] is None


def test_masks_samples_and_codec(spark):
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], [True, False, True])], "p array<array<double>>, m array<boolean>")
    assert df.select(V.masked("p", "m")).first()[0] == [[1.0], [3.0]]
    assert one(spark, V.even_sample(F.sequence(F.lit(0), F.lit(9)), 4)) == [0, 3, 6, 9]
    assert one(spark, V.even_sample(arr(1.0, 2.0), 4)) == [1.0, 2.0]
    assert one(spark, V.parse_vector(V.format_vector(arr(1.5, -2.0)))) == [1.5, -2.0]
    assert one(spark, V.parse_vector(F.lit("no"))) is None


CASES = [
    ("Obeng Plus PH2 150MM gagang hitam 1pcs", {"drive": ["PH2", "PHILLIPS"], "measurement": ["150MM"], "quantity": ["1PCS"], "color": ["HITAM"]}),
    ("Obeng Minus FLAT 6x150mm isi 2PCS", {"drive": ["FLAT"], "dimension": ["6X150MM"], "quantity": ["2PCS"]}),
    ("Kunci pas 10MM, 12 MM, kabel 1,5M, pipa 2 INCH, kuas 1\" dan 1.5\"", {"measurement": ['1"', '1.5"', "1.5M", "10MM", "12MM", "2INCH"]}),
    ("Sandal Swallow model 41 SIZE 40 hitam", {"size": ["SIZE40"], "color": ["HITAM"]}),
    ("Sandal 38 39 40 41 biru", {"color": ["BIRU"]}),
    ("Kuas cat 2\" JC414 putih 1 set, cat MERAH 5M", {"measurement": ['2"', "5M"], "model": ["JC414"], "quantity": ["1SET"], "color": ["MERAH", "PUTIH"]}),
    ("COL.SCREWDRIVER 6'", {"measurement": ['6"']}),
    ("", {}),
    (None, {}),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_attributes(spark, text, expected):
    assert one(spark, A.values(F.lit(text).cast("string"))) == expected


def test_colors_behind_the_first_4000_characters(spark, tmp_path):
    from shelfsight.plans.everything import QUERIES

    text = "red " + "x" * 4000 + " merah and blue"
    spark.createDataFrame([(1, text), (2, "Blue"), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["color"], r["n"], r["documents"]) for r in QUERIES["attribute_colors_of_documents"](spark, str(tmp_path)).collect()}
    assert got == {("RED", 1, 1), ("MERAH", 1, 1), ("BLUE", 2, 2)}
    assert one(spark, A.values(F.lit(text), limit=4000)) == {"color": ["RED"]}


def test_dimension_with_unit_and_measurement(spark):
    got = one(spark, A.values(F.lit("Lunch Box 19*11*6.5cm")))
    assert got["dimension"] == ["19X11X6.5CM"] and got["measurement"] == ["6.5CM"]
    raw = one(spark, A.parse(F.lit("plus 6 x 150mm")))
    assert [(r["key"], r["raw"]) for r in raw] == [("drive", "plus"), ("dimension", "6 x 150mm"), ("measurement", "150mm")]


def test_compatibility(spark):
    drive = lambda *v: arr(*v, kind="array<string>")
    assert one(spark, A.drive_score(drive("PH2", "PHILLIPS"), drive("PHILLIPS"))) == 0.5
    assert one(spark, A.drive_score(drive("PHILLIPS"), drive("FLAT"))) == 0
    assert one(spark, A.drive_score(drive("PH1"), drive("PH2"))) == 0.5
    a, b = A.values(F.lit("JC403-4 merah")), A.values(F.lit("JC403-6 merah"))
    assert one(spark, A.compatibility(a, b)) == 0.5
    assert one(spark, A.compatibility(a, A.values(F.lit("nothing")))) is None


def brute_normal(key, found):
    plain = re.sub(r"\s+", "", found.upper()).replace(",", ".")
    if key == "drive":
        return "PHILLIPS" if plain in ("PLUS", "PHILLIPS", "PHILIPS", "CROSS", "KEMBANG") else "FLAT" if plain in ("MINUS", "FLAT", "FLATHEAD", "SLOTTED") else plain
    if key == "dimension":
        plain = plain.replace("×", "X").replace("*", "X")
    return re.sub("['’]$", '"', plain) if key in ("dimension", "measurement") else {"PANJANG": "LONG", "PENDEK": "SHORT"}.get(plain, plain)


def brute_values(text):
    found = [(key, brute_normal(key, m.group(0))) for key, pattern in A.PATTERNS for m in re.finditer(pattern, text or "", re.IGNORECASE)]
    return {key: {v for k, v in found if k == key} for key, _ in found}


def brute_compatibility(a, b):
    family = lambda v: v[:2]
    score = lambda k: 0.5 if k == "drive" and not a[k] & b[k] and {family(v) for v in a[k]} & {family(v) for v in b[k]} else len(a[k] & b[k]) / len(a[k] | b[k])
    keys = a.keys() & b.keys()
    return round(sum(score(k) for k in keys) / len(keys), 6) if keys else None


def versions(spark, folder):
    """Products with all keys, each in two versions."""
    rng = random.Random(8)
    words = ["PH1", "ph2", "Phillips", "plus", "minus", "flat", "PZ1", "PZ2", "torx", "JC403-4", "JC404", "10 mm", "10MM", '1,5"', "6x150mm", "6 * 150 mm", "panjang", "LONG", "size 40", "2 pcs", "3pcs", "merah", "red", "-"]
    rows = [(i, day, " , ".join(rng.sample(words, rng.randrange(7)))) for i in range(200) for day in (1, 2)]
    rows += [(300, 1, "model JC404"), (300, 2, "JC404"), (301, 1, "PH1"), (301, 2, "PH2"), (302, 1, None), (302, 2, "10 MM"), (303, 1, "10mm"), (303, 2, "10 MM")]
    df = spark.createDataFrame(rows, "product_id bigint, day int, description string")
    df.selectExpr("product_id", "'S' AS sku", "description", "make_timestamp(2024, 1, day, 0, 0, 0) AS updated_at").write.parquet(f"{folder}/products.parquet")
    return {(i, day): brute_values(text) for i, day, text in rows}


def test_compatibility_over_all_keys_by_brute_force(spark, tmp_path):
    from shelfsight.plans.everything import QUERIES

    found = versions(spark, tmp_path)
    expected = {i: brute_compatibility(found[i, 2], found[i, 1]) for i, _ in found}
    got = {r["product_id"]: r["compatibility"] for r in QUERIES["attribute_compatibility"](spark, str(tmp_path)).collect()}
    assert got == {i: s for i, s in expected.items() if s is not None}
    assert (got[300], got[301], got[303]) == (1.0, 0.5, 1.0) and 302 not in got


def test_counts_of_all_keys_by_brute_force(spark, tmp_path):
    from shelfsight.plans.everything import QUERIES

    latest = {i: found for (i, day), found in versions(spark, tmp_path).items() if day == 2}
    expected = {k: (sum(k in found for found in latest.values()), len(set().union(*(found.get(k, ()) for found in latest.values())))) for k, _ in A.PATTERNS}
    got = {r["key"]: (r["products"], r["distinct_values"]) for r in QUERIES["attribute_distinct_all"](spark, str(tmp_path)).collect()}
    assert got == {k: n for k, n in expected.items() if n[0]} and "measurement" in got
    rows = QUERIES["attribute_parse_all"](spark, str(tmp_path)).collect()
    assert {(r["product_id"], r["key"], r["value"]) for r in rows} == {(i, k, v) for i, found in latest.items() for k, vs in found.items() for v in vs}
    assert [r["n"] for r in rows if (r["product_id"], r["value"]) == (303, "10MM")] == [1]


def test_rules_can_be_added(spark):
    more = A.RULES.plus("weight", "weight", r"\b\d+\s*KG\b")
    assert one(spark, A.values(F.lit("red 5 kg"), more)) == {"color": ["RED"], "weight": ["5KG"]}
    assert "weight" not in A.RULES.keys and more.only("weight").keys == ("weight",)
    (found,) = one(spark, A.parse(F.lit("5 kg"), more))
    assert tuple(found) == ("weight", "5KG", "5 kg", "weight", "parser")
    for name, pattern in (("weight", "x"), ("other", "(")):
        with pytest.raises(ValueError):
            more.plus(name, name, pattern)


def test_hash_distance(spark):
    d = lambda a, b: one(spark, bits.distance(F.conv(F.lit(a), 16, -10).cast("bigint"), F.conv(F.lit(b), 16, -10).cast("bigint")))
    assert (d("0" * 16, "0" * 16), d("0" * 16, "01" + "0" * 14), d("0" * 16, "f" * 16)) == (0, 1, 64)
    for bad in ("xyz", "0" * 15, "g" * 16, "", None, "0" * 16):
        assert one(spark, bits.code(F.lit(bad).cast("string"))) is None
    assert one(spark, bits.code(F.lit(" " + "F" * 16))) == -1


def test_close_codes_share_a_piece(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(200):
        x = int(rng.integers(-(2**63), 2**63 - 1))
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        rows.append((x, (y + 2**63) % 2**64 - 2**63))
    df = spark.createDataFrame(rows, "x bigint, y bigint")
    assert df.where(~F.arrays_overlap(bits.pieces_keys(F.col("x")), bits.pieces_keys(F.col("y")))).count() == 0


def test_text_functions(spark):
    assert X.terms("  Kunci\tPAS ") == ["kunci", "pas"]
    assert [one(spark, X.stem(F.lit(p))) for p in ("a/b/12.jpg", "x.y.png", "noext")] == ["12", "x.y", "noext"]
    assert one(spark, X.numeric_stem(F.lit("a/12.jpg"))) == 12 and one(spark, X.numeric_stem(F.lit("a/v12.jpg"))) is None
    assert one(spark, X.extension(F.lit("A.JPEG"))) == "jpg" and one(spark, X.extension(F.lit("A"))) is None
    assert one(spark, X.one_line(F.lit("a\n  b"), 3)) == "a b"
    assert one(spark, X.error_detail(F.lit('{"detail": "too  big"}'))) == "too big" and one(spark, X.error_detail(F.lit("plain"))) == "plain"
    assert one(spark, X.names_id(F.lit("Photo #42 was changed"))) == 42 and one(spark, X.names_id(F.lit("none"))) is None
    assert one(spark, X.mentions(F.lit("Must REBUILD"), "rebuild")) is True
    assert one(spark, X.token(F.lit(" ph\t2 "))) == "PH 2"
    assert one(spark, X.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, X.safe_sku(F.lit("A-1_b"))) is True and one(spark, X.safe_sku(F.lit("a/b"))) is False


def test_recognised_words(spark):
    tsv = "level\tx\n" + "\n".join(["5\t0\t0\t0\t0\t1\t10\t20\t30\t40\t90\tph2", "5\t0\t0\t0\t0\t1\t10\t20\t30\t40\t-1\tno", "4\t0\t0\t0\t0\t1\t0\t0\t1\t1\t90\tline", "5\t0\t0\t0\t0\t1\t90\t20\t30\t40\t50\twide", "5\t0"])
    got = one(spark, X.recognised_words(F.lit(tsv), F.lit(100.0), F.lit(100.0)))
    assert [(w["text"], w["confidence"], w["box"] is None) for w in got] == [("PH2", 90.0, False), ("WIDE", 50.0, True)]
    assert one(spark, X.confidence_weight(F.lit(80.0), 60)) == 0.5 and one(spark, X.confidence_weight(F.lit(None).cast("double"), 60)) is None


def box(*v):
    return B.make(*(F.lit(float(x)) for x in v))


def test_boxes(spark):
    a, b = box(0, 0, 0.4, 0.4), box(0.2, 0.2, 0.4, 0.4)
    assert one(spark, B.iou(a, b)) == pytest.approx(0.04 / 0.28)
    assert one(spark, B.containment(a, box(0.1, 0.1, 0.2, 0.2))) == pytest.approx(1)
    assert one(spark, B.is_valid(box(0.5, 0, 0.6, 1))) is False and one(spark, B.is_valid(box(0, 0, 1, 1))) is True
    assert one(spark, B.is_object(box(0, 0, 1, 1))) is False and one(spark, B.is_object(a)) is True
    assert one(spark, B.proportion(box(0, 0, 0.4, 0.1), box(0, 0, 0.1, 0.4))) == pytest.approx(1)
    assert one(spark, B.proportion(a, box(0, 0, 1, 1))) is None
    assert one(spark, B.quality(box(0.2, 0.2, 0.6, 0.5))) == pytest.approx((0.3 * 1 + 0.25 * (1 - 0.05) + 0.1 * (1 - abs(math.log(1.2 / 1.25)) / 2.8)) / 0.65)
    p = one(spark, B.to_pixels(box(0.101, 0, 0.5, 1), F.lit(100), F.lit(50)))
    assert tuple(p) == (10, 0, 51, 50)


def test_pixels():
    ramp = np.tile(np.arange(9), (8, 1)) * 20
    assert I.dhash(ramp) == "f" * 16 and I.dhash(ramp[:, ::-1]) == "0" * 16
    first = np.zeros((8, 9))
    first[0, 1:] = 200
    assert I.dhash(first) == "0" * 15 + "1"  # the first comparison is the lowest bit
    last = np.zeros((8, 9))
    last[7, 8] = 200
    assert I.dhash(last) == "8" + "0" * 15
    assert I.resize(np.full((20, 30), 77), 8, 9).tolist() == [[77] * 9] * 8
    assert I.laplacian_variance(np.full((10, 10), 7)) == 0 and I.laplacian_variance(np.eye(10) * 255) > 100
    assert I.pad_square(np.zeros((2, 4), np.uint8)).shape == (4, 4)
    assert set(I.views(np.zeros((10, 10, 3)))) == {"global", "center", "left", "right", "top", "bottom"}
    sizes = {n: v.shape for n, v in I.views(np.zeros((100, 80))).items()}
    assert sizes == {"global": (100, 80), "center": (75, 60), "left": (100, 60), "right": (100, 60), "top": (75, 80), "bottom": (75, 80)}
    assert I.tip_view(np.zeros((100, 80))).shape == (30, 80) and I.tip_view(np.zeros((1, 1))).shape == (1, 1)
    spot = np.zeros((32, 32))
    spot[20:23, 10:13] = 255
    s = np.fft.fftshift(I.spectral_saliency(spot))
    assert s.max() == 1 and s[19:24, 9:14].mean() > 3 * s.mean()
    assert I.saliency_term(np.ones((4, 4)), 0, 0, 4, 4) == pytest.approx((1 / 3) ** 0.5) and I.saliency_term(np.ones((4, 4)), 9, 9, 1, 1) == 0
    assert I.pixel_hash(np.zeros((2, 3), np.uint8)) != I.pixel_hash(np.zeros((3, 2), np.uint8))
    assert I.patch_mask(4, 4, 0, 0, 0.5, 0.5).sum() == 4


def test_image_tables(spark):
    rows = [(1, list(range(64)), 8), (2, None, 8), (3, [], 8), (4, [1, 2, 3], 2), (5, list(range(64)), 8)]
    df = spark.createDataFrame(rows, "id bigint, pixels array<int>, width int")
    got = {r["id"]: r for r in I.image_metrics(df, "id", "pixels", "width").collect()}
    assert got[1]["min_side"] == 8 and all(got[i]["dhash"] is None for i in (2, 3, 4))
    e = {r["id"]: r["embedding"] for r in I.encode_images(df.where("id <> 4"), I.stub_encoder(16)).collect()}
    assert e[1] == e[5] and len(e[1]) == 16 and e[2] is None and e[3] is None


@pytest.mark.parametrize("bad", [{"weights": {"a": 0.5}}, {"candidates": 10}, {"secondary_weight": 0.5}, {"candidates_per_sku": 0}, {"top_k": 51}, {"local_weight": float("nan")}, {"ambiguity_margin": -1}, {"patch_trim": 0.5}, {"patch_top_k": 3}, {"patch_aggregation": "max"}, {"high": 1.5}, {"high_gap": 2.5}, {"rank_bias": float("nan")}])
def test_settings(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
