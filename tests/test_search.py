"""Whole searches on synthetic references, the registry and a few queries against SQL."""

import glob
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import search as S
from shelfsight.settings import Settings
from shelfsight.sources import synthetic

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_search_finds_the_own_sku(spark, tmp_path):
    refs = synthetic.references(spark, 400, 40)
    vectors = synthetic.vectors(refs, {"siglip": 32, "dino": 24}, noise=0.4)
    assert vectors.count() == 1600
    got = S.search(refs, vectors, Settings()).where("rank = 1").collect()
    sku = {r["ref_id"]: r["sku"] for r in refs.collect()}
    assert len(got) == 8 and sum(r["sku"] == sku[r["query_id"]] for r in got) >= 7
    assert all(-1 <= r["score"] <= 1 and r["matched_images"] <= 3 for r in got)
    none = S.search(refs, vectors, Settings(threshold=0.9999))
    assert none.collect() == []
    both = S.scenarios(refs, vectors, {"all": Settings(), "global": Settings(local_weight=0.0)}, {"global": 1})
    assert {r["scenario"] for r in both.collect()} == {"all", "global"}
    assert S.search(refs.where("false"), vectors).collect() == []


def test_blend_and_secondary(spark):
    null = F.lit(None).cast("double")
    x = spark.range(1).select(S.blended(F.lit(0.5), F.lit(1.0), 0.2).alias("a"), S.blended(F.lit(0.5), null, 0.2).alias("b"), S.secondary_score(null, F.lit(0.4), 0.3).alias("c"), S.secondary_score(F.lit(1.0), F.lit(0.0), 0.3).alias("d"), S.secondary_score(null, null, 0.3).alias("e"),
        S.final_score(F.lit(0.5), null, Settings(secondary_weight=0.4)).alias("f"), S.final_score(F.lit(0.5), F.lit(1.0), Settings(secondary_weight=0.4, proportion_weight=0.1), F.lit(0.0)).alias("g")).first()
    assert x["a"] == pytest.approx(0.6) and x["b"] == 0.5 and x["c"] == pytest.approx(0.4) and x["d"] == pytest.approx(0.3) and x["e"] is None
    assert x["f"] == 0.5 and x["g"] == pytest.approx(0.9 * 0.7)


def test_registry_is_whole():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert subprocess.run([sys.executable, "-m", "shelfsight", "--list"], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["confidence_level", "eval_by_tag", "threshold_sweep", "duplicate_decision", "split_manifest_counts", "cover_photo_resolution", "vector_topk_cosine", "attribute_parse"])
def test_query_equals_sql(spark, name):
    import duckdb

    from shelfsight.plans.everything import ORACLE, QUERIES

    db = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    tidy = lambda x: None if x is None or x != x else round(x, 5) if isinstance(x, float) and math.isfinite(x) else x
    mine = sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=str)
    other = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert mine == sorted((tuple(tidy(x) for x in r) for r in other), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["vector_topk_cosine", "vector_topk_prefilter_category", "vector_topk_objects", "vector_threshold_limit"])
def test_lists_of_all_models(spark, name, monkeypatch):
    from shelfsight.plans.everything import QUERIES

    monkeypatch.setattr(sys.modules[__name__], "DATA", DATA.replace("sf0.001", "sf0.01"))  # the smallest has no query
    test_query_equals_sql(spark, f"{name}_by_model")
    rows = QUERIES[f"{name}_by_model"](spark, DATA).collect()
    assert {r["model"] for r in rows} == {"dino", "siglip"}
    tidy = lambda rows: {(r["query_id"], r["ref_id"], r["rank"], r["similarity"]) for r in rows}
    assert tidy(r for r in rows if r["model"] == "dino") == tidy(QUERIES[name](spark, DATA).collect())
