"""Session helpers: shared scratch folder, lineage cuts, table loading."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def _delete(path: str, conf) -> None:
    from pyspark import SparkContext

    where = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the one that all executors share, ``spark.checkpoint.dir``.

    Only on a single machine (a local master) may the session name none; a
    temporary folder is then made.  On a cluster that raises RuntimeError, as
    each executor would write to a disk of its own.  The folder is made once
    per application and deleted when the process ends.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app in _OWN:
        return _OWN[app]
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        path = f"{named.rstrip('/')}/shelfsight-{app}-{uuid.uuid4().hex[:8]}"
    elif context.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="shelfsight-")
        context.setCheckpointDir(path)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    conf = context._jsc.hadoopConfiguration()

    def clean() -> None:
        with contextlib.suppress(Exception):  # the virtual machine may be gone
            _delete(path, conf)

    atexit.register(clean)
    _OWN[app] = path
    return path


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives the loss of executors, as the files
    are outside of them.  ``discard`` deletes them.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*stages: DataFrame | str | None) -> None:
    """Delete the files of materialised tables (or of folders) that nothing reads any more."""
    for x in stages:
        path = x if isinstance(x, str) else getattr(x, "_scratch", None)
        if path:
            from pyspark import SparkContext

            _delete(path, SparkContext._active_spark_context._jsc.hadoopConfiguration())


def spread(df: DataFrame) -> DataFrame:
    """``df``, shared out over all cores if its files give fewer tasks than there are cores.

    For scans whose rows take much work: a file of one row group is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


@contextlib.contextmanager
def static_plans(spark: SparkSession) -> Iterator[None]:
    """Plans made once for what is executed within, as adaptive execution plans and reports again after each stage.

    For many executions in a row, each of whose partitions and joins are set
    by its own code; their plans would fill the driver's memory.
    """
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def guard(spark: SparkSession) -> None:
    """Turn off that a union passes on the partitioning of its inputs.

    In Spark 4.1 an aggregate over such a union leaves out its exchange even
    where the inputs' shuffle partitions were coalesced differently, and then
    returns a key more than once.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    guard(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
