"""Connected components of records that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.runtime import discard, materialise


def connected(links: DataFrame, record: str, key: str) -> DataFrame:
    """(record, first): the smallest record of the component, for every record of ``links``.

    ``links`` has (record bigint, key); records that have a key in common are
    tied, and ties carry on.  Each round takes the smallest label of each key
    and of each record, hooks the label's own record and follows labels of
    labels, so the rounds grow with the logarithm of a component's width.  A
    key's records are only aggregated, with partial aggregation before the
    shuffle, and never gathered, so a key may hold any share of the rows.
    Rows with null record or key are ignored; an empty table gives no row.
    """
    links = materialise(links.where(F.col(record).isNotNull() & F.col(key).isNotNull()).select(F.col(record).alias("r"), F.col(key).alias("k")).distinct(), "links")
    label = links.groupBy("k").agg(F.min("r").alias("f")).join(links, "k").groupBy("r").agg(F.min("f").alias("f"))
    label = materialise(label, "label")
    while True:
        by_key = links.join(label, "r").groupBy("k").agg(F.min("f").alias("f"))
        seen = links.join(by_key, "k").groupBy("r").agg(F.min("f").alias("seen"))
        step = label.join(seen, "r")
        # the record that is a label takes the smallest label seen by its followers
        hook = step.groupBy(F.col("f").alias("r")).agg(F.min("seen").alias("hook"))
        hooked = materialise(step.join(hook, "r", "left").select("r", F.col("f").alias("old"), F.least("f", "seen", F.coalesce("hook", "f")).alias("f")), "hooked")
        up = hooked.select(F.col("r").alias("f"), F.col("f").alias("up"))
        after = materialise(hooked.join(up, "f").select("r", "old", F.least("f", "up").alias("f")), "label")
        discard(label, hooked)
        label = after.select("r", "f")
        label._scratch = after._scratch
        if not after.where("f <> old").limit(1).count():
            discard(links)
            return label.select(F.col("r").alias(record), F.col("f").alias("first"))
