"""Catalogue tables: versions, search, joins with references, imports, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.functions import attributes as A
from shelfsight.functions import text as X


def first_or_last(df: DataFrame, key: list[str], order: list[str], last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by the order columns, ties by all other columns; any size of key.

    Done as an aggregate of structs, so a key's rows are combined before the
    shuffle.  Rows with a null key are left out.
    """
    rest = [c for c in df.columns if c not in (*key, *order)]
    pick = (F.max if last else F.min)(F.struct(*order, *rest)).alias("_r")
    for k in key:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*key).agg(pick).select(*key, "_r.*")


def latest_products(products: DataFrame) -> DataFrame:
    return first_or_last(products, ["product_id"], ["updated_at"])


def earliest_products(products: DataFrame) -> DataFrame:
    return first_or_last(products, ["product_id"], ["updated_at"], last=False)


def search_text(products: DataFrame, search: str) -> DataFrame:
    """Products of which every term is in the sku or the description."""
    return products.where(X.matches_terms(search, "sku", "description"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 12) -> DataFrame:
    """Page ``number`` (from 1) in the order, which must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def classify(current: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): new, unchanged, changed or deleted, by null-safe equality of the columns."""
    canonical = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(name))
    both = canonical(current, "old").join(canonical(incoming, "new"), key, "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def import_rows(rows: DataFrame, order: str) -> DataFrame:
    """Incoming (sku, description): sku trimmed, empty ones dropped, the last row of a sku wins, null text becomes empty."""
    tidy = rows.select(F.trim("sku").alias("sku"), F.coalesce("description", F.lit("")).alias("description"), order).where("sku <> ''")
    return first_or_last(tidy, ["sku"], [order]).select("sku", "description", order)


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """(sku, description, updated_at, change) after the import; unchanged rows keep their time.

    A null description that becomes empty counts as a change.
    """
    new = incoming.select("sku", F.col("description").alias("text"), F.col("updated_at").alias("time"))
    both = current.select("sku", "description", "updated_at", F.lit(True).alias("there")).join(new, "sku", "full")
    change = F.when(F.col("there").isNull(), "created").when(F.col("time").isNull() | F.col("description").eqNullSafe(F.col("text")), "unchanged").otherwise("updated")
    keep = F.col("change") == "unchanged"
    return both.withColumn("change", change).select("sku", F.when(keep, F.col("description")).otherwise(F.col("text")).alias("description"), F.when(keep, F.col("updated_at")).otherwise(F.col("time")).alias("updated_at"), "change")


def attribute_rows(products: DataFrame, record: str, text: str) -> DataFrame:
    """(record, key, value): the distinct parsed attributes."""
    return products.select(record, F.explode(A.parse(text)).alias("a")).select(record, "a.key", "a.value").distinct()


def refresh_attributes(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """(product_id, key, value, source): parser rows are replaced by the new parse, manual rows stay."""
    manual = stored.where("source <> 'parser'").select("product_id", "key", "value", "source")
    return manual.unionByName(parsed.select("product_id", "key", "value", F.lit("parser").alias("source"))).distinct()


def trusted_map(stored: DataFrame) -> DataFrame:
    """(product_id, trusted map<key, sorted values>) of the manual rows, in the generic normal form."""
    rows = stored.where("source = 'manual'").select("product_id", "key", A.plain(F.upper("value")).alias("value"))
    keys = rows.groupBy("product_id", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return keys.groupBy("product_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "values")))).alias("trusted"))


def covers(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, product_id, image_id): of ordered candidate ids the first that the product owns.

    ``candidates``: query_id, product_id, ids array; ``images``: product_id,
    image_id.  Without an owned candidate the product's first image is taken.
    """
    ids = candidates.select("query_id", "product_id", F.posexplode("ids").alias("pos", "image_id"))
    owned = images.select("product_id", "image_id").where("product_id IS NOT NULL AND image_id IS NOT NULL").distinct()
    first = ids.join(owned, ["product_id", "image_id"]).groupBy("query_id", "product_id").agg(F.min_by("image_id", "pos").alias("hit"))
    other = owned.groupBy("product_id").agg(F.min("image_id").alias("other"))
    rows = candidates.select("query_id", "product_id").distinct().join(first, ["query_id", "product_id"], "left").join(other, "product_id", "left")
    return rows.select("query_id", "product_id", F.coalesce("hit", "other").alias("image_id"))


def first_per_sku(refs: DataFrame, n: int, order: str = "image_id") -> DataFrame:
    """At most ``n`` references of a sku, in the order of a column."""
    place = F.row_number().over(Window.partitionBy("sku").orderBy(order))
    return refs.withColumn("place", place).where(F.col("place") <= n)
