"""Same or near-same records across splits.

Records are normalised texts of words: the content hash, the digest of the
group and the piece keys of the perceptual hash.  The held-out records'
passages, sharded, are the patterns of Aho-Corasick automata, which scan the
texts of all training records; a match gives the training record and the
interval.  Matched hashes and groups lead to the held-out records with them,
matched pieces to codes that are then compared exactly; and what is matched of
a held-out record's passage is merged into its coverage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsight.llm import bits
from shelfsight.llm.readings import clean_dhash, clean_group, clean_hash, dhash_bits
from shelfsight.runtime import discard, materialise, spread

#: Words of one automaton; a word has 65 characters at most, so this bounds what is broadcast and built.
SHARD_PATTERNS = 60_000
SEPARATOR = "\n"
#: Fixed lengths of a passage's fields.
HASH_CHARS, DHASH_CHARS = 64, 16


def normalised(df: DataFrame, record: str) -> DataFrame:
    """(record, hash, code, grp) by the common readings; repeated rows once."""
    return df.where(F.col(record).isNotNull()).select(record, clean_hash("photo_hash").alias("hash"), dhash_bits(clean_dhash("dhash")).alias("code"), clean_group("capture_group").alias("grp")).distinct()


#: Words of a normalised record; none holds the separator.
WORDS = f"""concat(
    CASE WHEN hash IS NULL THEN array() ELSE array(concat('h', hash)) END,
    CASE WHEN grp IS NULL THEN array() ELSE array(concat('g', sha2(grp, 256))) END,
    CASE WHEN code IS NULL THEN array() ELSE transform({bits.pieces("code")}, k -> concat('d', hex(k))) END)"""


def automaton(words: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(f"{SEPARATOR}{w}{SEPARATOR}", w)
    if len(out):
        out.make_automaton()
    return out


def scan(patterns: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of all matches of whole words in a text of words between separators."""
    return [(end - len(p), end, p) for end, p in patterns.iter(text)] if len(patterns) else []


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _matches(shared):
    """Rows (right, code, word, lo, hi) of the texts (right, code, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, words = shared.value
        if name not in _BUILT:  # a worker keeps the automaton of the shard it is at
            _BUILT.clear()
            _BUILT[name] = automaton(words)
        patterns = _BUILT[name]
        for b in batches:
            row, word, lo, hi = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                for start, end, p in scan(patterns, text):
                    row.append(i)
                    word.append(p)
                    lo.append(start)
                    hi.append(end)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(word, pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["right", "code", "word", "lo", "hi"])

    return run


def matched(held_out: DataFrame, training: DataFrame, record: str) -> DataFrame:
    """(right, code, word, lo, hi): which words of the held-out records stand where in the training records' texts.

    Both tables are normalised ones.  The words are cut into shards of some
    SHARD_PATTERNS, each of which is broadcast; all texts are scanned once for
    each shard.
    """
    spark = held_out.sparkSession
    words = materialise(held_out.select(F.explode(F.expr(WORDS)).alias("word")).distinct(), "words")
    shards = max(1, -(-words.count() // SHARD_PATTERNS))
    text = F.concat(F.lit(SEPARATOR), F.array_join(F.expr(WORDS), SEPARATOR), F.lit(SEPARATOR))
    texts = materialise(spread(training.select(F.col(record).alias("right"), "code", text.alias("text"))), "texts")
    out = None
    for s in range(shards):
        own = [r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == s).collect()]
        kind = training.schema[record].dataType.simpleString()
        found = texts.mapInArrow(_matches(spark.sparkContext.broadcast((uuid.uuid4().hex, own))), f"right {kind}, code bigint, word string, lo int, hi int")
        out = found if out is None else out.unionByName(found)
    out = materialise(out, "matches")
    discard(words, texts)
    return out


def overlaps(held_out: DataFrame, training: DataFrame, left: str = "eval_id", right: str = "feedback_id") -> DataFrame:
    """(left, right, same_hash, near_hash, same_group): all pairs with equal hash, close dhash or equal group.

    Both tables have photo_hash, dhash and capture_group; further columns do
    not matter.  What does not count by the common readings never matches;
    null ids give nothing; repeated rows count once.  An empty table on either
    side gives no row.
    """
    a, b = materialise(normalised(held_out, left), "held_out"), normalised(training, right)
    found = matched(a, b, right)
    whole = a.select(F.col(left), F.explode(F.expr(WORDS)).alias("word")).where("substring(word, 1, 1) <> 'd'").distinct()
    same = found.where("substring(word, 1, 1) <> 'd'").select("right", "word").distinct().join(whole, "word").select(left, F.col("right").alias(right), F.when(F.substring("word", 1, 1) == "h", 1).otherwise(4).alias("kind"))
    pieces = found.where("substring(word, 1, 1) = 'd'").select(F.conv(F.expr("substring(word, 2)"), 16, 10).cast("bigint").alias("key"), F.col("code").alias("y")).distinct()
    codes = bits.pairs(bits.keyed(a, "code", "x"), pieces, "x", "y")
    own = a.where("code IS NOT NULL").select(left, F.col("code").alias("x")).distinct()
    other = found.where("substring(word, 1, 1) = 'd'").select(F.col("right").alias(right), F.col("code").alias("y")).distinct()
    near = own.join(codes, "x").join(other, "y").select(left, right, F.lit(2).alias("kind"))
    kinds = same.unionByName(near).groupBy(left, right).agg(F.bit_or("kind").alias("kinds"))
    flag = lambda bit: F.col("kinds").bitwiseAND(F.lit(bit)) != 0
    return kinds.select(left, right, flag(1).alias("same_hash"), flag(2).alias("near_hash"), flag(4).alias("same_group"))


def exported(feedback: DataFrame) -> DataFrame:
    """Feedback whose trimmed lower-case training_status is ``exported``."""
    return feedback.where(F.lower(F.trim("training_status")) == "exported")


def coverage(held_out: DataFrame, pairs: DataFrame, record: str = "eval_id") -> DataFrame:
    """(record, chars, matched, spans, coverage): how much of a held-out record's passage training has.

    The passage is the hash, the dhash and the group, as far as they count,
    one after the other.  A field that some training record matches is an
    interval of it; intervals that meet are merged into spans.  coverage is
    null for a record without any field that counts.
    """
    lengths = normalised(held_out, record).groupBy(record).agg(
        F.max(F.when(F.col("hash").isNotNull(), HASH_CHARS)).alias("h"), F.max(F.when(F.col("code").isNotNull(), DHASH_CHARS)).alias("d"), F.max(F.length("grp")).alias("g"))
    h, d, g = (F.coalesce(c, F.lit(0)) for c in "hdg")
    got = pairs.groupBy(record).agg(*(F.max(c).alias(c) for c in ("same_hash", "near_hash", "same_group")))
    part = lambda ok, lo, n: F.when(F.col(ok), F.struct(lo.cast("int").alias("lo"), (lo + n).cast("int").alias("hi")))
    parts = F.array(part("same_hash", F.lit(0), h), part("near_hash", h, d), part("same_group", h + d, g))
    rows = lengths.join(got, record, "left").select(record, (h + d + g).alias("chars"), F.filter(parts, lambda p: p.isNotNull()).alias("parts"))
    intervals = rows.select(record, F.explode("parts").alias("p")).select(record, "p.lo", "p.hi")
    before = F.max("hi").over(Window.partitionBy(record).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.withColumn("new", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    merged = new.groupBy(record).agg(F.sum(F.col("hi") - F.col("lo")).cast("int").alias("matched"), F.sum("new").cast("int").alias("spans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(merged, record, "left").select(record, "chars", zero("matched"), zero("spans"), F.when(F.col("chars") > 0, F.coalesce("matched", F.lit(0)) / F.col("chars")).alias("coverage"))


def report(held_out: DataFrame, pairs: DataFrame, record: str = "eval_id") -> DataFrame:
    """(split, source, records, overlapping, pairs) over the held-out records.

    split and source are trimmed and lower-cased, null becomes ``unknown``; a
    record's repeated rows count once, under its smallest (split, source).
    """
    tidy = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("unknown")).alias(c)
    records = held_out.where(F.col(record).isNotNull()).select(record, tidy("split"), tidy("source")).groupBy(record).agg(F.min(F.struct("split", "source")).alias("s"))
    n = pairs.groupBy(record).agg(F.count("*").alias("n"))
    return records.join(n, record, "left").groupBy(F.col("s.split").alias("split"), F.col("s.source").alias("source")).agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
