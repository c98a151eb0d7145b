"""Deduplicating new batches against all history.

What was accepted lies in one bucketed table of the shared folder, by a
64-bit mark: a row for each exact content hash (with the hash itself) and
fifteen for each perceptual hash, its paragraphs (with the code).  A delivery
is joined with it bucket by bucket, so only the delivery is shuffled; its own
order is settled in rounds while it has many links, else and in the end by one
task that goes through them, and the marks of what it adds are appended.  The
number of buckets follows from the rows; after a number of appends the table
is compacted, with as many buckets as it then needs.

A delivery costs the driver three executions (links, order, append), as each
one's plans and events stay in its memory for a while; a large one has its
popular keys looked for first, so that only plans that need it cut keys finer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import bits
from shelfsight.llm.readings import clean_dhash, clean_hash
from shelfsight.runtime import discard, materialise, scratch_path, static_plans

#: Marks of a bucket (some 30 bytes each) for which buckets are made.
ROWS_PER_BUCKET = 4_000_000
#: Appends after which the files of a bucket are merged into one again.
APPENDS = 16
#: Links (some 200 bytes each there) that one task goes through; more are settled in rounds until so many are left.
ONE_TASK = 500_000


def _marks(values: DataFrame) -> DataFrame:
    """(key, hash, code) of values (hash, code), of which one is null."""
    return values.selectExpr(f"explode(CASE WHEN hash IS NOT NULL THEN array(xxhash64(hash)) ELSE {bits.pieces('code')} END) AS key", "hash", "code")


#: The id of what comes before all records.
FIRST = -(1 << 63)
#: SQL of the hash and the code of a record as two values ``v``.
EACH = "explode(array(struct(hash, CAST(NULL AS bigint) AS code), struct(CAST(NULL AS string) AS hash, code))) AS v"


def _values(nodes: DataFrame) -> DataFrame:
    """(hash, code), one of them null: the distinct hashes and codes of ``nodes``."""
    return nodes.selectExpr(EACH).selectExpr("v.*").where("hash IS NOT NULL OR code IS NOT NULL").distinct()


#: What a round writes of a link.
SETTLED = "id bigint, hash string, code bigint, key string, state string"


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SETTLED links of the accepted records of links (id, hash, code, key) in the order of their ids: the ones none of whose keys is taken take them."""
    taken: set[str] = set()
    last, own = FIRST, []
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())

    def settled() -> list[tuple]:
        if last != FIRST and any(x[3] in taken for x in own):
            return []
        taken.update(x[3] for x in own)
        return [(*x, "accepted") for x in own if last != FIRST]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "hash", "code", "key", "state"])

    for b in batches:
        out = []
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[0] != last:
                out += settled()
                last, own = x[0], []
            own.append(x)
        if out:
            yield batch(out)
    if out := settled():
        yield batch(out)


class History:
    """The bucketed marks and the batches checked against them."""

    def __init__(self, spark: SparkSession, rows_per_bucket: int = ROWS_PER_BUCKET, appends: int = APPENDS, popular: int = bits.POPULAR, one_task: int = ONE_TASK):
        self.spark, self.rows_per_bucket, self.most_appends, self.popular, self.one_task = spark, rows_per_bucket, appends, popular, one_task
        self.folder = scratch_path(spark, "history")
        self.name: str | None = None
        self.buckets = self.appends = self.rounds = 0

    def _needed(self, rows: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // self.rows_per_bucket))

    def _write(self, marks: DataFrame) -> None:
        rows = marks.select("key", "hash", "code").repartition(self.buckets, "key")
        if self.spark.catalog.tableExists(self.name):
            rows.write.insertInto(self.name)  # one execution
        else:
            rows.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{self.folder}/{self.name}").saveAsTable(self.name)

    def add(self, values: DataFrame) -> None:
        """Append the marks of values (hash, code) that the history doesn't have."""
        if self.name is None:
            marks = materialise(_marks(values), "marks")
            self.name, self.buckets = f"history_{uuid.uuid4().hex}", self._needed(marks.count())
            self._write(marks)
            discard(marks)
            return
        self._write(_marks(values))
        self.appends += 1
        if self.appends >= self.most_appends:
            self._compact()

    def _compact(self) -> None:
        """One sorted file for each bucket again, in as many buckets as the rows need; costs less than the checks since the last time read."""
        old, rows = self.name, self.spark.table(self.name)
        self.name, self.appends, self.buckets = f"history_{uuid.uuid4().hex}", 0, max(self.buckets, self._needed(rows.count()))
        self._write(rows)
        self._forget(old)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(f"{self.folder}/{name}")

    def _many(self, rows: DataFrame, most: int | None) -> DataFrame | None:
        """(key) of the keys that more than ``popular`` codes of a delivery have, written; None if there is none, as with at most so many records."""
        if most is not None and most <= self.popular:
            return None
        seen = Observation()
        keys = _marks(_values(rows).where("code IS NOT NULL")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > self.popular).select("key")
        many = materialise(keys.observe(seen, F.count(F.lit(1)).alias("n")), "many")
        if seen.get["n"]:
            return many
        discard(many)
        return None

    def _matches(self, rows: DataFrame, many: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Of a delivery (id, hash, code): the (hash, code) that the history holds, one of them null, and the close (code, other) of the delivery.

        ``many``: the keys to cut finer.
        """
        marks = _marks(_values(rows)).repartition(self.buckets, "key")
        codes = marks.where("code IS NOT NULL").select("key", "code")
        other = codes.withColumnRenamed("code", "other")
        old = self.spark.table(self.name).select("key", F.col("hash").alias("old_hash"), F.col("code").alias("old_code"))
        same = F.coalesce(F.col("hash") == F.col("old_hash"), bits.close("code", "old_code"))
        near = (F.col("code") < F.col("other")) & bits.close("code", "other")
        if many is None:
            known = marks.hint("shuffle_hash").join(old, "key").where(same).select("hash", "code")
            pairs = codes.hint("shuffle_hash").join(other, "key").where(near).select("code", "other")
        else:
            # keys that many codes of the delivery have are cut finer, on both sides and in the history
            seldom, often = marks.join(many, "key", "left_anti"), codes.join(many, "key", "left_semi")
            cut, held = bits.cut(often, "key", "code"), bits.cut(old.where("old_code IS NOT NULL").join(many, "key", "left_semi"), "key", "old_code")
            known = seldom.hint("shuffle_hash").join(old, "key").where(same).select("hash", "code")
            known = known.unionByName(cut.withColumn("hash", F.lit(None).cast("string")).join(held, ["key", "fine"]).where(same).select("hash", "code"))
            pairs = seldom.where("code IS NOT NULL").join(other, "key").where(near).select("code", "other")
            pairs = pairs.unionByName(cut.join(cut.withColumnRenamed("code", "other"), ["key", "fine"]).where(near).select("code", "other"))
        return known.distinct(), pairs.distinct()

    def _links(self, rows: DataFrame, many: DataFrame | None) -> DataFrame:
        """(id, hash, code, key) of what links the records of a delivery: a hash, a code, a pair of close codes.

        What the history holds is linked to a record before all others.
        """
        known, pairs = self._matches(rows, many)
        name = F.coalesce(F.concat(F.lit("h"), "hash"), F.concat(F.lit("c"), F.col("code").cast("string"))).alias("key")
        own = rows.selectExpr("id", EACH).select("id", "v.*").where("hash IS NOT NULL OR code IS NOT NULL")
        pair = F.concat_ws("~", F.col("code").cast("string"), F.col("other").cast("string"))
        sides = pairs.select(F.explode(F.array("code", "other")).alias("code"), pair.alias("key"))
        none = (F.lit(None).cast("string").alias("hash"), F.lit(None).cast("bigint").alias("code"))
        links = own.select("id", "hash", "code", name)
        return links.unionByName(rows.join(sides, "code").select("id", *none, "key")).unionByName(known.select(F.lit(FIRST).alias("id"), *none, name))

    def check(self, records: DataFrame, record: str, most: int | None = None) -> DataFrame:
        """(record) of the accepted ones of a delivery, whose hashes are appended; they come in the order of their ids.

        ``records``: the id, ``hash`` and ``code`` (bigint), either of which
        may be null; at most ``most`` of them, if known.  A record is not
        accepted if its hash is in the history or that of an earlier accepted
        record of the delivery, or its code within 4 bits of such a one's.
        Records without both are new, leave no trace and aren't returned.  An
        empty delivery changes nothing.
        """
        rows = records.where("hash IS NOT NULL OR code IS NOT NULL").select(F.col(record).cast("bigint").alias("id"), "hash", "code")
        many, seen = self._many(rows, most), Observation()
        links = materialise(self._links(rows, many).observe(seen, F.count(F.lit(1)).alias("n")), "links")
        accepted = self._settle(links, seen.get["n"])
        self.add(accepted.where("hash IS NOT NULL OR code IS NOT NULL").select("hash", "code"))
        discard(links, many)
        return accepted.select(F.col("id").alias(record)).distinct()

    def _settle(self, links: DataFrame, n: int) -> DataFrame:
        """Links (id, hash, code) of the accepted records of the ``n`` links (id, hash, code, key).

        A round looks for the first record of each key, and from it for the
        first one that each record is linked to.  If that is the record
        itself, it is accepted, and its keys pass to FIRST; if it is FIRST,
        the record is known and its links go; else it stays open.  The first
        open record is always decided.  Links are aggregated with partial
        minima and never gathered, and the sides of the joins have distinct
        keys; they are shuffled, as a broadcast in each round would go through
        the driver.  At most ``one_task`` links are gone through record by
        record in one task, with the same outcome.
        """
        out = None
        while True:
            seen = Observation()
            if n <= self.one_task:
                after = links.coalesce(1).sortWithinPartitions("id").mapInArrow(_in_order, SETTLED)
            else:
                first = links.groupBy("key").agg(F.min("id").alias("first")).hint("shuffle_hash")
                found = links.where(F.col("id") != FIRST).select("id", "key").join(first, "key").groupBy("id").agg(F.min("first").alias("first"))
                state: Column = F.when(F.col("id") == FIRST, "held").when(F.col("first") == FIRST, "known").when(F.col("first") == F.col("id"), "accepted").otherwise("open")
                after = links.join(found.hint("shuffle_hash"), "id", "left").select("id", "hash", "code", "key", state.alias("state")).where("state <> 'known'")
            self.rounds += 1
            path, schema = f"{self.folder}/rounds/{self.rounds:08d}", after.schema
            after.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "open").alias("open")).write.parquet(path)
            after = self.spark.read.schema(schema).parquet(path)
            new = after.where("state = 'accepted'").select("id", "hash", "code")
            out = new if out is None else out.unionByName(new)
            if not seen.get["open"]:
                return out
            n = seen.get["n"]
            links = after.select(F.when(F.col("state") == "accepted", FIRST).otherwise(F.col("id")).alias("id"), "hash", "code", "key")

    def accepted(self) -> DataFrame:
        """(id) of all records accepted in checks."""
        return self.spark.read.parquet(f"{self.folder}/rounds/*").where("state = 'accepted'").select("id")

    def drop(self) -> None:
        if self.name:
            self._forget(self.name)
            self.name = None


def first_deliveries(feedback: DataFrame) -> DataFrame:
    """(feedback_id, batch_no, hash, code): each record once, in its smallest batch."""
    from shelfsight.llm.readings import dhash_bits

    rows = feedback.where("feedback_id IS NOT NULL").select("feedback_id", F.struct("batch_no", clean_hash("photo_hash").alias("hash"), dhash_bits(clean_dhash("dhash")).alias("code")).alias("r"))
    return rows.groupBy("feedback_id").agg(F.min("r").alias("r")).select("feedback_id", "r.*")


def duplicates_by_batch(feedback: DataFrame, refs: DataFrame, **options) -> DataFrame:
    """(feedback_id) of the records that are not new, going through the batches in order.

    The references' clean photo hashes are the first history; then each batch
    is a delivery, checked against what was accepted so far.  Records with a
    null batch come first.  ``options`` are those of History.
    """
    spark = feedback.sparkSession
    history = History(spark, **options)
    history.add(_values(refs.select(clean_hash("photo_hash").alias("hash"), F.lit(None).cast("bigint").alias("code"))))
    records = materialise(first_deliveries(feedback), "records")
    batches = sorted(((r[0], r[1]) for r in records.groupBy("batch_no").count().collect()), key=lambda b: (b[0] is not None, b[0]))
    with static_plans(spark):
        for number, n in batches:
            history.check(records.where(F.col("batch_no").eqNullSafe(F.lit(number))), "feedback_id", n)
    history.drop()
    hashed = records.where("hash IS NOT NULL OR code IS NOT NULL").select("feedback_id")
    return hashed.join(history.accepted(), hashed["feedback_id"] == F.col("id"), "left_anti") if batches else hashed
