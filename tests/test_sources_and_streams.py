import json

import pytest
from pyspark.sql import functions as F

from shelfsight.sources import files
from shelfsight.streaming import stateful as T


def test_image_folders(spark, tmp_path):
    for sku, name, body in (("007", "a.JPG", b"123"), ("007", "a.json", b'{"view": "front"}'), ("x", "b.png", b"1" * 50), ("x", "c.txt", b"t"), ("x", "b.json", b"[1]")):
        (tmp_path / sku).mkdir(exist_ok=True)
        (tmp_path / sku / name).write_bytes(body)
    assert {(r["sku"], r["name"]) for r in files.images(spark, str(tmp_path)).collect()} == {("007", "a.JPG"), ("x", "b.png")}
    assert files.images(spark, str(tmp_path), max_bytes=10).count() == 1
    assert {(r["sku"], r["stem"], r["sidecar"]) for r in files.sidecars(spark, str(tmp_path)).collect()} == {("007", "a", '{"view": "front"}'), ("x", "b", None)}
    (tmp_path / "metadata.json").write_text(json.dumps({"007": {"family": "f", "category": "c"}, "bad": 3}))
    meta = files.metadata(spark, str(tmp_path / "metadata.json"))
    rows = spark.createDataFrame([("007", '{"family": "own"}'), ("zz", None)], "sku string, extra string")
    got = {r["sku"]: (r["family"], r["category"]) for r in files.with_metadata(rows, meta, ["family", "category"]).collect()}
    assert got == {"007": ("own", "c"), "zz": (None, None)}
    old = files.older_than(spark, f"{tmp_path}/*/*", F.lit("2100-01-01").cast("timestamp"), 900)
    assert old.count() == 5


def test_json_lines(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n[1]\n')
    good, bad = files.json_lines(spark, str(p), "a bigint, b string")
    assert {(r["a"], r["b"]) for r in good.where("a IS NOT NULL").collect()} == {(1, "x"), (2, None)}
    assert "not json" in {r["raw"] for r in bad.collect()}
    assert files.numbered_errors(str(p), ["a", "b"]) == [(3, "not JSON"), (4, "missing b"), (5, "not an object")]


def test_spreadsheet_and_sinks(spark, tmp_path):
    files.template(str(tmp_path / "t.csv"), ["sku", "desc"])
    with open(tmp_path / "t.csv", "a") as f:
        f.write('001,"a, b"\n')
    (row,) = files.spreadsheet(spark, str(tmp_path / "t.csv"), ["sku", "desc", "more"]).collect()
    assert (row["sku"], row["desc"], row["more"]) == ("001", "a, b", None)
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id bigint, split string")
    files.write_splits(df, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).where("split = 'test'").count() == 1
    with pytest.raises(Exception, match="already exists"):
        files.write_splits(df, str(tmp_path / "splits"))
    files.write_report(df, str(tmp_path / "r"))
    files.write_report(df, str(tmp_path / "r"), overwrite=True)


def test_versions(spark, tmp_path):
    table = files.VersionedTable(spark, str(tmp_path / "v"))
    assert table.current() is None
    with pytest.raises(FileNotFoundError):
        table.load()
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    first = table.publish(df, "s1")
    assert table.current() == first and table.load("s1").count() == 2
    with pytest.raises(ValueError, match="rebuild"):
        table.load("s2")
    more = spark.createDataFrame([("b", 2), ("c", 3)], "id string, n int")
    second = table.delta(more, "id", ["n"], "s1")
    assert second != first and sorted(r["id"] for r in table.load().collect()) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="changed"):
        table.delta(spark.createDataFrame([("a", 9)], "id string, n int"), "id", ["n"], "s1")
    assert table.current() == second and len(table.versions()) == 2
    part = next((tmp_path / "v" / second / "rows").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError, match="changed"):
        table.load()
    (tmp_path / "v" / "CURRENT").write_text("../elsewhere")
    assert table.current() is None


def stream(spark, tmp_path, rows, schema, name="in"):
    """A file stream of the rows, one file for each list."""
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"{i}"))
    kind = spark.read.parquet(str(tmp_path / name / "0")).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


TIMES = "k string, t string, revision bigint"


def at(s):
    return f"2026-01-{1 + s // 86400:02d} {s // 3600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def test_live_evidence(spark, tmp_path):
    rows = [[("a", at(0), 1), ("a", at(60), 2), (None, at(1), 3)], [("b", at(4000), 4)], [("b", at(9000), 5)]]
    got = run(T.live_evidence(stream(spark, tmp_path, rows, TIMES), "k", "t"), tmp_path, "live", "update")
    assert ("a", 2, "expired") in {(r["k"], r["n"], r["state"]) for r in got}
    assert ("a", 2, "live") in {(r["k"], r["n"], r["state"]) for r in got}


def test_confirmations(spark, tmp_path):
    staged = stream(spark, tmp_path, [[("a", at(0), 1), ("b", at(0), 2)], [("z", at(9000), 9)]], TIMES, "staged")
    confirmed = stream(spark, tmp_path, [[("a", at(900), 3), ("b", at(901), 4)], [("y", at(9000), 9)]], TIMES, "confirmed").withColumnRenamed("t", "at")
    got = run(T.confirmations(staged, confirmed, ["k"], "t", "at"), tmp_path, "confirmed", "append")
    assert [(r["k"], r["revision"], r["confirmed_revision"]) for r in got] == [("a", 1, 3)]


def test_once_rates_and_revisions(spark, tmp_path):
    rows = [[("a", at(i), i) for i in range(25)] + [("b", at(3), 3)], [("a", at(5), 5), ("c", at(90000), 7)]]
    source = stream(spark, tmp_path, rows, TIMES)
    assert sorted(r["revision"] for r in run(T.once(source, ["revision"], "t"), tmp_path, "once", "append")) == sorted({*range(25), 7})
    got = run(T.rates(source, "k", "t"), tmp_path, "rates", "append")
    assert [(r["k"], r["n"]) for r in got] == [("a", 26)]
    got = run(T.revisions(source, "t"), tmp_path, "revisions", "append")
    assert got[0]["revision"] == 24


def test_drain_appends_once(spark, tmp_path):
    source = stream(spark, tmp_path, [[("a", at(0), 1), ("b", at(0), 2)], [("a", at(5), 3), ("c", at(5), 4), (None, at(5), 5)]], TIMES)
    out = str(tmp_path / "out")
    T.drain(source, T.append_new(out, "k"), str(tmp_path / "c1"))
    T.drain(source, T.append_new(out, "k"), str(tmp_path / "c2"))  # all batches come again
    assert {(r["k"], r["revision"]) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 2), ("c", 4)}
    assert spark.read.parquet(out).count() == 3
