"""File sources and sinks: image folders, sidecars, JSON lines, spreadsheets, versions with a pointer."""

from __future__ import annotations

import csv
import hashlib
import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfsight.functions import text as X
from shelfsight.operators.lifecycle import GENERATION

EXTENSIONS = ("jpg", "png", "webp")


def images(spark: SparkSession, root: str, max_bytes: int = 20_000_000) -> DataFrame:
    """(sku, name, path, length, modified, content) of ``root/<sku>/<image>``; other kinds and too long files are left out.

    The sku stays a string with its leading zeros.
    """
    rows = spark.read.format("binaryFile").load(f"{root}/*/*")
    part = lambda n: F.element_at(F.split("path", "/"), n)
    rows = rows.where(X.extension("path").isin(*EXTENSIONS) & (F.col("length") <= max_bytes))
    return rows.select(part(-2).alias("sku"), part(-1).alias("name"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(sku, stem, sidecar) of ``root/<sku>/<image>.json``; sidecar is null where it is not a JSON object."""
    rows = spark.read.format("binaryFile").load(f"{root}/*/*").where(F.lower("path").endswith(".json"))
    text = F.decode("content", "utf-8")
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("sku"), X.stem("path").alias("stem"), F.when(F.trim(text).startswith("{") & F.get_json_object(text, "$").isNotNull(), text).alias("sidecar"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(sku, meta map) of one JSON object by sku; entries that are no objects are dropped."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("sku", "json"))
    return rows.where(F.trim("json").startswith("{")).select("sku", F.from_json("json", "map<string,string>").alias("meta"))


def with_metadata(rows: DataFrame, meta: DataFrame, keys: list[str], extra: str = "extra") -> DataFrame:
    """Adds each key from the row's own JSON, else from the sku's metadata, else null."""
    joined = rows.join(meta, "sku", "left")
    return joined.select(*rows.columns, *(F.coalesce(F.get_json_object(extra, f"$.{k}"), F.try_element_at("meta", F.lit(k))).alias(k) for k in keys))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows (file, raw)) of JSON lines; blank lines are skipped."""
    fields = StructType.fromDDL(schema)
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), "value")
    parsed = lines.withColumn("r", F.from_json("value", StructType([*fields.fields]).add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r._bad IS NULL AND r IS NOT NULL").select(*(F.col(f"r.{f.name}").alias(f.name) for f in fields)), parsed.where("r._bad IS NOT NULL OR r IS NULL").select("file", F.col("value").alias("raw"))


def numbered_errors(path: str, required: list[str]) -> list[tuple[int, str]]:
    """(line, problem) of one local JSON-lines file, streamed."""
    out = []
    with open(path, encoding="utf-8") as f:
        for n, line in enumerate(f, 1):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
            except ValueError:
                out.append((n, "not JSON"))
                continue
            if not isinstance(row, dict):
                out.append((n, "not an object"))
            elif missing := [k for k in required if k not in row]:
                out.append((n, "missing " + ", ".join(missing)))
    return out


def spreadsheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a table with a header row, as strings, and ``row_no``.

    CSV is read by Spark; .xlsx and .xls by pandas on the driver, if its
    reader is installed.
    """
    if path.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        rows = spark.createDataFrame(pd.read_excel(path, dtype=str).where(lambda x: x.notna(), None))
    else:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = {c.strip().lower(): c for c in rows.columns}
    return rows.select(*((F.col(f"`{named[c]}`") if c in named else F.lit(None)).cast("string").alias(c) for c in columns), F.monotonically_increasing_id().alias("row_no"))


def template(path: str, columns: list[str]) -> None:
    """An empty spreadsheet with the header row."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerow(columns)


def older_than(spark: SparkSession, pattern: str, now: Column, seconds: int) -> DataFrame:
    """(path, age) of files older than so many seconds."""
    rows = spark.read.format("binaryFile").load(pattern).select("path", (now.cast("timestamp").cast("bigint") - F.col("modificationTime").cast("bigint")).alias("age"))
    return rows.where(F.col("age") > seconds)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder per split; refuses to overwrite."""
    rows.write.mode("errorifexists").partitionBy(split).json(path)


def write_report(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


class VersionedTable:
    """Immutable versions of a table under a folder, with a pointer to the current one.

    A version is written, read again and compared with its counts, and only
    then the pointer is replaced in one step.  Readers keep the version they
    resolved.  The folder is one that the driver sees as a path; versions
    themselves are written by the executors.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def current(self) -> str | None:
        """Name of the current version; None without a pointer or with a malformed one."""
        try:
            name = (self.root / "CURRENT").read_text().strip()
        except FileNotFoundError:
            return None
        return name if re.fullmatch(GENERATION, name) and (self.root / name).is_dir() else None

    def _check(self, name: str) -> dict:
        """The manifest of a version, held against its files."""
        m = json.loads((self.root / name / "manifest.json").read_text())
        for file, digest in m["files"].items():
            with open(self.root / name / "rows" / file, "rb") as f:
                if hashlib.file_digest(f, "sha256").hexdigest() != digest:
                    raise ValueError(f"{name}/{file} was changed")
        return m

    def publish(self, rows: DataFrame, signature: str) -> str:
        """Write a version and make it current."""
        name = f"generation-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(str(self.root / name / "rows"))
        stored = self.spark.read.parquet(str(self.root / name / "rows"))
        files = {}
        for p in sorted((self.root / name / "rows").glob("*.parquet")):
            with open(p, "rb") as f:
                files[p.name] = hashlib.file_digest(f, "sha256").hexdigest()
        manifest = {"version": 2, "signature": signature, "count": stored.count(), "files": files}
        (self.root / name / "manifest.json").write_text(json.dumps(manifest, sort_keys=True))
        self._check(name)
        fresh = self.root / f".CURRENT-{uuid.uuid4().hex}"
        fresh.write_text(name)
        os.replace(fresh, self.root / "CURRENT")
        return name

    def load(self, signature: str | None = None) -> DataFrame:
        """The current version, after its check; another signature than the stored one raises."""
        name = self.current()
        if name is None:
            raise FileNotFoundError("no current version")
        m = self._check(name)
        if signature is not None and m["signature"] != signature:
            raise ValueError("the version was made with other settings; rebuild it")
        rows = self.spark.read.parquet(str(self.root / name / "rows"))
        if rows.count() != m["count"]:
            raise ValueError(f"{name} has not the rows of its manifest")
        return rows

    def delta(self, incoming: DataFrame, key: str, columns: list[str], signature: str) -> str:
        """Publish current plus new rows; raises if an incoming row differs from a stored one of its key.

        Rows that are no longer incoming stay.
        """
        from shelfsight.operators.catalog import classify

        old = self.load(signature)
        change = classify(old, incoming, key, columns)
        if bad := change.where("change = 'changed'").limit(5).collect():
            raise ValueError("changed, so rebuild: " + ", ".join(str(r[key]) for r in bad))
        new = incoming.join(change.where("change = 'new'").select(key), key, "left_semi")
        return self.publish(old.unionByName(new.select(*old.columns)), signature)

    def versions(self) -> list[tuple[str, float]]:
        """(name, time) of all published versions, newest first."""
        found = [(p.name, p.stat().st_mtime) for p in self.root.glob("generation-*") if p.is_dir()]
        return sorted(found, key=lambda x: (-x[1], x[0]))
