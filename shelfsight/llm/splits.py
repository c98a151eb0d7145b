"""Splits that keep related records together.

Grouped iterative stratification: records tied by hash or group form
components; their label vectors are summed; the rarest outstanding label goes
first, and its components, the heaviest first, each to the split that needs
the label most.

Within a label all components of one weight are interchangeable, so how many
of them each split gets follows from its needs alone, and is computed without
going through the components: the histogram of a label's weights has at most
sqrt(2 n) rows for n records, as the distinct weights add up to n at most.
Which component goes where is its place in its weight class, found by prefix
sums over buckets.  Labels that share no open component are placed together.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm.components import connected
from shelfsight.llm.readings import clean_group, clean_hash
from shelfsight.runtime import discard, materialise

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Components of one bucket of the prefix sums within a weight class.
BUCKET_ROWS = 100_000
NO_LABEL = "(none)"
#: Needs are counted in parts of a record, so that ties are exact.
SCALE = 10**6


def tie_links(records: DataFrame, record: str = "eval_id") -> DataFrame:
    """(record, key) of the clean hash and the clean group."""
    keys = F.array(F.concat(F.lit("h"), clean_hash("photo_hash")), F.concat(F.lit("g"), clean_group("capture_group")))
    return records.select(record, F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def tied_sets(records: DataFrame, record: str = "eval_id") -> DataFrame:
    """(record, first) for all records, each once; a record tied to none is its own first.

    Null ids are left out.
    """
    ids = records.where(F.col(record).isNotNull()).select(record).distinct()
    return ids.join(connected(tie_links(records, record), record, "key"), record, "left").select(record, F.coalesce("first", record).alias("first"))


def shares(need: list[float], weight: int, m: int) -> list[int]:
    """How many of ``m`` components of one weight each split gets, each going where the need is largest just then.

    These are the m largest of need, need - weight, need - 2 weight, ... of all
    splits (ties to the first split), so a level is sought above which there
    are no more than m of them.
    """
    whole, step = [round(n * SCALE) for n in need], weight * SCALE
    above = lambda level: [max(0, -((level - n) // step)) for n in whole]
    low, high = min(whole) - step * (m + 1), max(whole)
    while high - low > 1:
        level = (low + high) // 2
        low, high = (level, high) if sum(above(level)) > m else (low, level)
    got = above(high)
    for _ in range(m - sum(got)):  # those at the level itself, at most one of each split
        got[max(range(len(need)), key=lambda s: (whole[s] - step * got[s], -s))] += 1
    return got


def _plan(names: list[str]):
    """Of each label and weight: the components each split gets, as (split, first place, end)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        need = [float(pdf[f"need_{s}"].iloc[0]) for s in names]
        out = []
        for label, w, m in pdf.sort_values("w", ascending=False)[["label", "w", "m"]].itertuples(index=False):
            at = 0
            for s, n in enumerate(shares(need, int(w), int(m))):
                need[s] -= n * w
                if n:
                    out.append((label, w, names[s], at, at + n))
                at += n
        return pd.DataFrame(out, columns=["label", "w", "split", "lo", "hi"])

    return run


def _places(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (first, label, w) with ``place``, from 0, in the order of a hash within (label, w); classes: (label, w, m)."""
    h = F.xxhash64("first", F.lit("place"))
    rows = rows.join(classes, ["label", "w"]).select("first", "label", "w", h.alias("h"), F.pmod(h, F.ceil(F.col("m") / BUCKET_ROWS)).alias("b"))
    sizes = rows.groupBy("label", "w", "b").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label", "w").orderBy("b")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("label", "w", "b").orderBy("h", "first")) - 1
    return rows.withColumn("own", own).join(sizes.select("label", "w", "b", before.alias("before")), ["label", "w", "b"]).select("first", "label", "w", (F.col("before") + F.col("own")).alias("place"))


def stratified_splits(sets: DataFrame, labels: DataFrame, record: str = "eval_id", proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """(record, first, split): a split for each record, the same within a set.

    ``sets``: (record, first).  ``labels``: (record, label), a record having
    any number of labels; null labels are ignored, and records without any
    share a label of their own.  An empty table gives no row.

    A round places every label that is the rarest outstanding one (by open
    records, then by name) of each open component that has it; the others'
    needs are lowered by what was placed.  So the rounds are as many as the
    labels of the longest chain, not as the labels; nothing is collected.
    """
    names = list(proportions)
    pairs = sets.join(labels.where("label IS NOT NULL").select(record, "label").distinct(), record, "left").select("first", F.coalesce("label", F.lit(NO_LABEL)).alias("label"))
    vectors = materialise(pairs.groupBy("first", "label").agg(F.count("*").alias("w")), "labels")
    total = vectors.groupBy("label").agg(F.sum("w").alias("total"))
    needs = materialise(total.select("label", *((F.col("total") * proportions[s]).alias(f"need_{s}") for s in names)), "needs")
    open_, placed = vectors, None
    while open_.limit(1).count():
        left = open_.groupBy("label").agg(F.sum("w").alias("left"))
        rows = open_.join(left, "label").withColumn("rank", F.struct("left", "label"))
        rarest = rows.groupBy("first").agg(F.min("rank").alias("rarest"))
        held = rows.join(rarest, "first")
        ready = held.groupBy("label").agg(F.bool_and(F.col("rank") == F.col("rarest")).alias("ready")).where("ready").select("label")
        now = materialise(open_.join(ready, "label", "left_semi"), "now")
        classes = now.groupBy("label", "w").agg(F.count("*").alias("m"))
        plan = classes.join(needs, "label").groupBy("label").applyInPandas(_plan(names), "label string, w bigint, split string, lo bigint, hi bigint")
        at = _places(now, classes).join(plan, ["label", "w"]).where("place >= lo AND place < hi")
        new = materialise(at.select("first", "split"), "placed")
        got = open_.join(new, "first").groupBy("label").agg(*(F.sum(F.when(F.col("split") == s, F.col("w")).otherwise(0)).alias(f"got_{s}") for s in names))
        after = needs.join(got, "label", "left").select("label", *((F.col(f"need_{s}") - F.coalesce(f"got_{s}", F.lit(0))).alias(f"need_{s}") for s in names))
        needs, old_needs = materialise(after, "needs"), needs
        open_, old = materialise(open_.join(new, "first", "left_anti"), "open"), open_
        placed = new if placed is None else placed.unionByName(new)
        discard(now, old_needs, *([old] if old is not vectors else []))
    if placed is None:
        return sets.select(record, "first", F.lit(None).cast("string").alias("split")).where("false")
    return sets.join(placed, "first").select(record, "first", "split")


def balance(labels: DataFrame, placed: DataFrame, record: str = "eval_id", proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """(label, split, records, wanted, got, heaviest): how near the splits come to their shares of each label.

    ``placed`` is the result of stratified_splits(); records without a label
    are under NO_LABEL, heaviest is the largest number of the label's records
    in one set.
    """
    rows = placed.join(labels.where("label IS NOT NULL").select(record, "label").distinct(), record, "left").select("first", "split", F.coalesce("label", F.lit(NO_LABEL)).alias("label"))
    sets = rows.groupBy("label", "first", "split").agg(F.count("*").alias("w"))
    sums = sets.groupBy("label").agg(F.sum("w").alias("records"), F.max("w").alias("heaviest"), *(F.sum(F.when(F.col("split") == s, F.col("w")).otherwise(0)).alias(s) for s in proportions))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("split"), (F.col("records") * p).alias("wanted"), F.col(s).alias("got")) for s, p in proportions.items())))
    return sums.select("label", "records", "heaviest", each.alias("s")).select("label", "s.split", "records", "s.wanted", "s.got", "heaviest")
