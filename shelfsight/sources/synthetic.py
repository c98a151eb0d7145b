"""Synthetic load: references with unit vectors around shared centres, made by the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def references(spark: SparkSession, n: int, skus: int, seed: int = 42) -> DataFrame:
    """(ref_id, image_id, sku, category, family, representation) of n references; the same for a seed."""
    r = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    sku = r("sku", skus)
    return spark.range(n).select(
        F.col("id").alias("ref_id"), F.format_string("img-%08d", "id").alias("image_id"), F.format_string("SKU-%07d", sku).alias("sku"),
        F.format_string("category-%d", sku % 8).alias("category"), F.format_string("family-%d", sku % 97).alias("family"), F.when(r("rep", 3) > 0, "object").otherwise("full").alias("representation"),
    )


def vectors(refs: DataFrame, dimensions: dict[str, int], views: tuple[str, ...] = ("global", "center"), noise: float = 0.5, seed: int = 42) -> DataFrame:
    """(ref_id, model, view, value): a unit vector near its sku's centre for each model and view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, skus = b.column(0).to_pylist(), [hash_of(s) for s in b.column(1).to_pylist()]
            for k, (model, d) in enumerate(dimensions.items()):
                for j, view in enumerate(views):
                    m = np.stack([np.random.default_rng([seed, k, s]).standard_normal(d) + noise * np.random.default_rng([seed, k, j, i, 1]).standard_normal(d) for i, s in zip(ids, skus, strict=True)]) if ids else np.empty((0, d))
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * d, pa.int32()), pa.array(m.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([model] * len(m), pa.string()), pa.array([view] * len(m), pa.string()), values], names=["ref_id", "model", "view", "value"])

    return refs.select("ref_id", "sku").mapInArrow(run, "ref_id bigint, model string, view string, value array<double>")


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())
