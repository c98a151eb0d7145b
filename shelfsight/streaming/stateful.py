"""Streaming operators: expiring evidence, confirmations, deduplication, drains.

All work on any streaming or batch DataFrame with the named columns; times are
``timestamp``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS = 900


def with_time(df: DataFrame, time: str) -> DataFrame:
    """The time column as ``timestamp``, as watermarks need it."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def live_evidence(events: DataFrame, key: str, time: str, ttl: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, first_seen, last_seen, n, state) as state of each key changes: ``live`` updates, then ``expired``.

    A key expires when the watermark passes its last event by the time to
    live; a later event begins anew.  Events later than the watermark are
    dropped.  Rows with a null key or time are left out.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "first_seen": [pd.Timestamp(first, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")], "n": [n], "state": ["expired"]})
            return
        first, last, n = state.get if state.exists else (None, None, 0)
        for b in batches:
            t = b[time].astype("datetime64[us]").astype("int64")
            first = int(t.min()) if first is None else min(first, int(t.min()))
            last = int(t.max()) if last is None else max(last, int(t.max()))
            n += len(b)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "first_seen": [pd.Timestamp(first, unit="us")], "last_seen": [pd.Timestamp(last, unit="us")], "n": [n], "state": ["live"]})

    kind = events.schema[key].dataType.simpleString()
    rows = with_time(events, time).where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time).withWatermark(time, late)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_seen timestamp, last_seen timestamp, n bigint, state string", "first bigint, last bigint, n bigint", "update", GroupStateTimeout.EventTimeTimeout)


def confirmations(staged: DataFrame, confirmed: DataFrame, keys: list[str], staged_time: str, confirmed_time: str, ttl: int = TTL_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Staged rows joined with the confirmations of equal keys that follow within the time to live.

    A stream-stream interval join: both sides have watermarks and the state
    of the staged side is dropped once nothing can match it.
    """
    a = with_time(staged, staged_time).withWatermark(staged_time, late).alias("a")
    b = with_time(confirmed, confirmed_time).withWatermark(confirmed_time, late).alias("b")
    on = (F.col(f"b.{confirmed_time}") >= F.col(f"a.{staged_time}")) & (F.col(f"b.{confirmed_time}") <= F.col(f"a.{staged_time}") + F.expr(f"INTERVAL {ttl} SECONDS"))
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).select("a.*", *(F.col(f"b.{c}").alias(f"confirmed_{c}") for c in confirmed.columns if c not in keys))


def once(events: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark's delay; state is bounded by it."""
    return with_time(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rates(events: DataFrame, user: str, time: str, window: str = "1 minute", most: int = 20, late: str = "10 minutes") -> DataFrame:
    """(user, start, n) of windows with more than ``most`` events of a user."""
    rows = with_time(events, time).withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w"), user).agg(F.count("*").alias("n")).where(F.col("n") > most).select(user, F.col("w.start").alias("start"), "n")


def revisions(mutations: DataFrame, time: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, mutations, revision): many mutations of a window as one highest revision."""
    rows = with_time(mutations, time).withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("mutations"), F.max("revision").alias("revision")).select(F.col("w.start").alias("start"), "mutations", "revision")


def append_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows whose key is not yet stored; a batch that comes again adds nothing.

    Within a batch the first row of a key by all columns counts.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        pick = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*")
        try:
            old = spark.read.schema(pick.schema).parquet(path).select(key)
            pick = pick.join(old, key, "left_anti")
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        pick.write.mode("append").parquet(path)

    return sink


def drain(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there now, batch by batch, and stop."""
    q = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
