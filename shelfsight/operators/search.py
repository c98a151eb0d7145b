"""Search of a query set against indexed references: shortlists, fusion, rescoring, decision.

Queries and references are tables; every step is a DataFrame step over all
queries at once.  Only the shortlist step leaves the JVM, for block matrix
products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions import vectors as V
from shelfsight.runtime import materialise
from shelfsight.settings import Settings

#: Query vectors of one block: bounds what is broadcast (about 2 MB of 64 numbers).
QUERY_BLOCK = 4096
#: References that are compared with a block at a time: bounds the matrix of scores.
ROW_CHUNK = 1024
DIGITS = 9


def clean_refs(refs: DataFrame) -> DataFrame:
    """One row per ref_id, sku trimmed and in upper case; null ids and skus are left out."""
    rows = refs.where("ref_id IS NOT NULL AND sku IS NOT NULL").select("ref_id", "image_id", F.upper(F.trim("sku")).alias("sku"), F.lower(F.trim("category")).alias("category"), "family", F.lower(F.trim("representation")).alias("representation"))
    return rows.groupBy("ref_id").agg(F.min(F.struct("image_id", "sku", "category", "family", "representation")).alias("r")).select("ref_id", "r.*")


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(ref_id, model, view, value array<double> of unit length): the valid vectors, of repeated ones the smallest id."""
    rows = vectors.where(F.size("value") == F.col("dimension")).select("vector_id", "ref_id", F.lower(F.trim("embedding_type")).alias("model"), F.lower(F.trim("crop_type")).alias("view"), V.normalize("value").alias("value")).where("value IS NOT NULL")
    first = rows.groupBy("ref_id", "model", "view").agg(F.min_by("value", "vector_id").alias("value"))
    return first.select("ref_id", "model", "view", "value")


def _matrix(c: pa.ListArray) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


class _Best:
    """The k best references of each query of one list, fed with chunks; ties go to the smaller id."""

    def __init__(self, names: np.ndarray, q: np.ndarray, k: int):
        self.names, self.q, self.k = names, q, k
        self.least = np.full(len(names), -np.inf)  # a query's k-th best so far
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        s = np.round(np.clip(self.q @ m.T, -1, 1), DIGITS)
        s[self.names[:, None] == ids[None]] = -np.inf  # a query does not find itself
        if not self.parts and s.shape[1] > self.k:
            self.least = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
        i, j = np.nonzero((s >= self.least[:, None]) & (s > -np.inf))
        self.parts.append((i, ids[j], s[i, j]))
        self.pending += len(i)
        if self.pending > 4 * self.k * len(self.names) + 100_000:
            self.settle()

    def settle(self) -> None:
        i, ids, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -s, i))
        i, ids, s = i[order], ids[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < self.k
        self.least[i[place == self.k - 1]] = s[place == self.k - 1]
        self.parts, self.pending = [(i[first], ids[first], s[first])], 0


def _block_top(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: _Best(names, q, k) for n, (names, q) in shared.value.items()}
        for b in batches:
            rows: dict[str, list[int]] = {}
            for i, names in enumerate(b.column(1).to_pylist()):
                for n in names:
                    rows.setdefault(n, []).append(i)
            for n in rows.keys() & best.keys():
                for lo in range(0, len(rows[n]), ROW_CHUNK):
                    part = b.take(pa.array(rows[n][lo : lo + ROW_CHUNK]))
                    best[n].add(part.column(0).to_numpy(), _matrix(part.column(2)))
        for n, top in best.items():
            if top.parts:
                top.settle()
                i, ids, s = top.parts[0]
                yield pa.RecordBatch.from_arrays([pa.array(top.names[i]), pa.array([n] * len(i), pa.string()), pa.array(ids), pa.array(s)], names=["query_id", "list", "ref_id", "score"])

    return run


def list_tops(queries: DataFrame, references: DataFrame, k: int, about: int) -> DataFrame:
    """(query_id, list, ref_id, score, rank): the k best references of each query in each list.

    ``queries``: query_id bigint, list string, value; ``references``: ref_id
    bigint, lists array<string>, value.  The vectors of a list have one length
    and unit norm.  All lists go in one scan of the references and one
    exchange.  ``about`` is the number of query rows; they are taken in blocks
    of QUERY_BLOCK, each broadcast, and only k rows for each query and list
    leave a task.
    """
    spark = queries.sparkSession
    blocks, out = max(1, -(-about // QUERY_BLOCK)), None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        got = part.select("list", "query_id", "value").toArrow()
        if not len(got):
            continue
        names, sides = np.array(got["list"].to_pylist(), object), {}
        for n in sorted(set(names)):
            own = got.take(pa.array(np.flatnonzero(names == n)))
            sides[n] = own["query_id"].to_numpy(), _matrix(own["value"].combine_chunks())
        shared = spark.sparkContext.broadcast(sides)
        found = references.select("ref_id", "lists", "value").mapInArrow(_block_top(shared, k), "query_id bigint, list string, ref_id bigint, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, list string, ref_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "ref_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_top_k(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(query_id, ref_id, score, rank): the k references of highest inner product for each query.

    ``queries``: query_id bigint, value; ``references``: ref_id bigint, value;
    unit vectors of one length.  A reference with the query's own id is not
    found.  Score is clipped, rounded to 9 digits; ties go to the smaller id.
    Empty tables give no row.
    """
    one = F.lit("all")
    return list_tops(queries.select("query_id", one.alias("list"), "value"), references.select("ref_id", F.array(one).alias("lists"), "value"), k, queries.count()).drop("list")


def shortlists(queries: DataFrame, refs: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """(query_id, list, ref_id, score, rank, weight): one list per model and index.

    ``queries``: query_id, is_object.  Each model has a list over all
    references; a query of an object has a second one over object references,
    and the model's weight is shared out by object_index_weight.  The query's
    vectors are those of the reference of its id.
    """
    is_object = F.coalesce(F.col("representation") == "object", F.lit(False))
    stored = vectors.where("view = 'global'").where(F.col("model").isin(*s.weights)).join(refs.select("ref_id", is_object.alias("object")), "ref_id")
    names = lambda flag: F.transform(F.when(flag, F.array(F.lit("all"), F.lit("object"))).otherwise(F.array(F.lit("all"))), lambda x: F.concat("model", F.lit(":"), x))
    stored = stored.select("ref_id", names(F.col("object")).alias("lists"), "model", "value")
    own = stored.drop("lists").withColumnRenamed("ref_id", "query_id").join(queries.select("query_id", F.coalesce("is_object", F.lit(False)).alias("is_object")), "query_id")
    own = own.select("query_id", F.explode(names(F.col("is_object"))).alias("list"), "value")
    top = list_tops(own, stored, s.candidates, queries.count() * 2 * len(s.weights)).join(queries.select("query_id", "is_object"), "query_id")
    share = F.when(F.col("list").endswith(":object"), s.object_index_weight).when(F.col("is_object"), 1 - s.object_index_weight).otherwise(1.0)
    weight = F.lit(None).cast("double")
    for model, w in s.weights.items():
        weight = F.when(F.col("list").startswith(f"{model}:"), w).otherwise(weight)
    return top.select("query_id", "list", "ref_id", "score", "rank", (weight * share).alias("weight"))


def fuse_ranks(lists: DataFrame, bias: int = 60) -> DataFrame:
    """(query_id, ref_id, fused): weighted reciprocal ranks summed over the lists."""
    return lists.groupBy("query_id", "ref_id").agg(F.round(F.sum(F.col("weight") / (F.lit(bias) + F.col("rank"))), 12).alias("fused"))


def cap_per_sku(fused: DataFrame, refs: DataFrame, per_sku: int, limit: int) -> DataFrame:
    """The fused candidates, at most per_sku of a sku, then at most limit of a query."""
    rows = fused.join(refs.select("ref_id", "sku"), "ref_id")
    best = [F.desc("fused"), F.asc("ref_id")]
    capped = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "sku").orderBy(*best))).where(F.col("n") <= per_sku)
    return capped.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("place") <= limit).drop("n")


def model_scores(pairs: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """(query_id, ref_id, model, context, object, score) for each model of which both sides have the whole image.

    context is the cosine of the whole images; object blends it with the
    symmetric best match of the other views by local_weight; score is object
    for two full images, the blend by global_weight for two objects, and
    context for a mixed pair.
    """
    wide = vectors.groupBy("ref_id", "model").agg(
        F.min(F.when(F.col("view") == "global", F.col("value"))).alias("whole"),
        F.collect_list(F.when(F.col("view") != "global", F.struct("view", "value"))).alias("v"),
    ).select("ref_id", "model", "whole", F.transform(F.array_sort("v"), lambda x: x["value"]).alias("views"))
    wide = wide.where("whole IS NOT NULL")
    q = wide.select(F.col("ref_id").alias("query_id"), "model", F.col("whole").alias("q"), F.col("views").alias("qv"))
    both = pairs.join(q, "query_id").join(wide, ["ref_id", "model"])
    context = F.round(V.clip(V.dots("q", "whole")), DIGITS)
    local = V.view_similarity("qv", "views")
    w = s.local_weight
    # without views on a side there is no local match, and the whole image decides
    blend = F.coalesce(V.clip((1 - w) * F.col("context") + w * local), F.col("context")) if w > 0 else F.col("context")
    rows = both.withColumn("context", context).withColumn("object", F.round(blend, DIGITS))
    g = s.global_weight
    score = F.when(F.col("q_object") & F.col("r_object"), V.clip((1 - g) * F.col("object") + g * F.col("context"))).when(F.col("q_object") != F.col("r_object"), F.col("context")).otherwise(F.col("object"))
    return rows.select("query_id", "ref_id", "model", "context", "object", F.round(score, DIGITS).alias("score"))


def visual_scores(scored: DataFrame, s: Settings) -> DataFrame:
    """(query_id, ref_id, visual_score, <model>_score...): the weighted mean over the models present."""
    each = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"{m}_score") for m in s.weights]
    rows = scored.groupBy("query_id", "ref_id").agg(*each)
    return rows.withColumn("visual_score", F.round(V.clip(V.weighted_mean([(F.col(f"{m}_score"), w) for m, w in s.weights.items()])), DIGITS))


def blended(score: Column, detail: Column, weight: float) -> Column:
    """A model's score mixed with a detail score (patches, tips); without one the score stays."""
    return score if weight == 0 else F.when(detail.isNull(), score).otherwise(V.clip((1 - weight) * score + weight * detail))


def secondary_score(text: Column, attributes: Column, description_weight: float) -> Column:
    """Weighted mean of text and attribute evidence over what is present; null if nothing is."""
    return V.weighted_mean([(text, description_weight), (attributes, 1 - description_weight)])


def final_score(visual: Column, secondary: Column, s: Settings, proportion: Column | None = None) -> Column:
    """Visual score, mixed with the secondary and the proportion evidence where there is any."""
    w, r = s.secondary_weight, s.proportion_weight
    score = F.when(secondary.isNull(), visual).otherwise(V.clip((1 - w) * visual + w * secondary)) if w else visual
    if r and proportion is not None:
        score = F.when(proportion.isNull(), score).otherwise(V.clip((1 - r) * score + r * proportion))
    return score


def aggregate_skus(rows: DataFrame) -> DataFrame:
    """(query_id, sku, score, image_id, family, matched_images, matched_image_ids, rank).

    ``rows``: query_id, sku, image_id, family, score.  A sku's score is that
    of its best reference, ties to the smaller image_id, null ids last; the
    ids come best first; skus rank by score, ties to the smaller sku.  Null scores are left
    out.
    """
    order = [(-F.col("score")).alias("s"), F.col("image_id").isNull().alias("no_id"), "image_id"]
    best = F.min(F.struct(*order, F.col("family").isNull().alias("no_family"), "family")).alias("best")
    ids = F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["image_id"])
    rows = rows.where("score IS NOT NULL").groupBy("query_id", "sku").agg(best, F.count("*").alias("matched_images"), ids.alias("matched_image_ids"))
    rows = rows.select("query_id", "sku", (-F.col("best.s")).alias("score"), "best.image_id", "best.family", "matched_images", "matched_image_ids")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "sku")))


def decide(skus: DataFrame, s: Settings) -> DataFrame:
    """(query_id, confidence, score_gap, kept, ambiguous, reason, alternatives) of ranked skus.

    Confidence and gap come from all skus; the threshold then drops skus and
    forces ``low`` if none is left; ambiguity looks at the first five that are
    left.  A single sku has no gap and is never ``high``.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = skus.withColumn("gap", F.col("score") - F.lead("score").over(order))
    passes = F.lit(True) if s.threshold is None else F.col("score") >= s.threshold
    rows = rows.withColumn("passes", passes)
    top = F.max(F.when(F.col("passes"), F.col("score"))).over(Window.partitionBy("query_id"))
    tied = F.col("passes") & (F.col("rank") <= 5) & (F.round(top - F.col("score"), DIGITS) <= s.ambiguity_margin)
    rows = rows.withColumn("tied", tied)
    one = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"),
        F.round(F.max(F.when(F.col("rank") == 1, F.col("gap"))), DIGITS).alias("score_gap"),
        F.count_if("passes").alias("kept"),
        F.count_if("tied").alias("n_tied"),
        F.count_distinct(F.when(F.col("tied"), F.col("family"))).alias("families"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tied"), F.struct("rank", "sku")))), lambda x: x["sku"]), ",").alias("alternatives"),
    )
    level = F.when(F.col("kept") == 0, "low").when((F.col("first") >= s.high) & (F.col("score_gap") >= s.high_gap), "high").when(F.col("first") >= s.medium, "medium").otherwise("low")
    ambiguous = F.col("n_tied") >= 2
    reason = F.when(ambiguous & (F.col("families") == 1), "same_family_variants").when(ambiguous, "near_tie")
    return one.select("query_id", level.alias("confidence"), "score_gap", "kept", ambiguous.alias("ambiguous"), reason.alias("reason"), "alternatives")


def query_set(refs: DataFrame) -> DataFrame:
    """The stated query set: references whose id is divisible by 50, as (query_id, is_object)."""
    return refs.where("ref_id % 50 = 0").select(F.col("ref_id").alias("query_id"), (F.col("representation") == "object").alias("is_object"))


def candidates(refs: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """The capped candidates of the query set with their visual scores and reference columns."""
    queries = query_set(refs)
    capped = cap_per_sku(fuse_ranks(shortlists(queries, refs, vectors, s), s.rank_bias), refs, s.candidates_per_sku, s.candidates)
    pairs = capped.join(queries, "query_id").join(refs.select("ref_id", "image_id", "family", F.coalesce(F.col("representation") == "object", F.lit(False)).alias("r_object")), "ref_id")
    pairs = pairs.withColumn("q_object", F.coalesce("is_object", F.lit(False)))
    scored = visual_scores(model_scores(pairs.select("query_id", "ref_id", "q_object", "r_object"), vectors, s), s)
    return pairs.select("query_id", "ref_id", "sku", "image_id", "family", "fused", "place").join(scored, ["query_id", "ref_id"])


def search(refs: DataFrame, vectors: DataFrame, s: Settings | None = None) -> DataFrame:
    """(query_id, rank, sku, image_id, score, matched_images, evidence, confidence, ambiguous): the ranked skus of each query."""
    s = s or Settings()
    # ranked once and written, as both the verdict and the rows need it
    skus = materialise(aggregate_skus(candidates(refs, vectors, s).withColumn("score", F.col("visual_score"))), "skus")
    verdict = decide(skus, s).select("query_id", "confidence", "ambiguous")
    kept = skus if s.threshold is None else skus.where(F.col("score") >= s.threshold)
    return kept.where(F.col("rank") <= s.top_k).join(verdict, "query_id").select("query_id", "rank", "sku", "image_id", "score", "matched_images", F.array_join("matched_image_ids", ",").alias("evidence"), "confidence", "ambiguous")


def scenarios(refs: DataFrame, vectors: DataFrame, variants: dict[str, Settings], references_per_sku: dict[str, int] | None = None) -> DataFrame:
    """search() under several settings, with a ``scenario`` column; a scenario may use a few references per sku only."""
    out = None
    for name, s in variants.items():
        n = (references_per_sku or {}).get(name)
        place = F.row_number().over(Window.partitionBy("sku").orderBy("image_id", "ref_id"))
        # the queries stay, whatever is left of the references
        some = refs if n is None else refs.withColumn("_n", place).where((F.col("_n") <= n) | (F.col("ref_id") % 50 == 0)).drop("_n")
        rows = search(some, vectors, s).withColumn("scenario", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no scenario")
    return out
