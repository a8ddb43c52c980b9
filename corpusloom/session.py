"""Session-level helpers: table reading, code shipping, lineage cuts and task sizing."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Applications that already have the package on their executors.
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors of a cluster; nothing to do in local mode.

    Files added to the context are fetched again by every executor that starts later, so this
    holds when executors are lost and replaced.
    """
    context = spark.sparkContext
    if is_local(spark) or context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, Path("corpusloom") / source.relative_to(package))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Only in local mode, where it may be unset as in tests, a temporary one is made; on a cluster a
    folder of one machine would be lost with it, so that fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
    return named or tempfile.mkdtemp(prefix=f"corpusloom-{name}-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the reliable checkpoint folder, see :func:`shared_folder`.

    Its files go when the result is no longer used and ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set.
    """
    spark = df.sparkSession
    scala_context = spark.sparkContext._jsc.sc()
    if scala_context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what is no longer used, which it else does only when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, *order: str) -> DataFrame:
    """``df`` computed once and written as Parquet to the shared folder, by ``order`` within its tasks; for tables of as many rows as there are pairs.

    A checkpoint takes 40 bytes and more for a pair, a compressed column a few. Shuffles that nothing
    uses any more are let go afterwards. The files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark, 'stored')}/stored-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*order) if order else df).write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of ``df``; None where it knows none, as for local rows, or multiplied sides of joins beyond sense."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return estimate if estimate < 1 << 55 else None


def _plain_scan(df: DataFrame) -> bool:
    """Whether ``df`` is no more than columns and conditions over files."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.nodeName().startswith("Relation") or plan.nodeName() == "LogicalRelation"


def spread(df: DataFrame, *keys: str | Column, task_mb: int = 24, size: int | None = None) -> DataFrame:
    """``df`` in as many partitions as work that is heavy on CPU needs.

    At least three tasks a core, and one for every ``task_mb`` of estimated input, so that the number
    follows the data without an upper bound; given explicitly, as adaptive coalescing looks at bytes
    and not at CPU time. ``size`` is the estimate where that of ``df`` itself says nothing. Without an
    estimate it is the session's number of shuffle partitions. A scan of so many files' splits that
    these are three tasks a core already is left as it is, without a shuffle, unless ``keys`` ask for one.
    """
    spark = df.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, size or plan_bytes(df)
    if size is not None and not keys:
        split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
        if size >= 3 * cores * split and _plain_scan(df):
            return df
    wanted = -(-size // (task_mb << 20)) if size is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(max(3 * cores, wanted), 2**31 - 1), *keys)


def small(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """``df`` hinted for broadcast when its row count was checked to be at most ``most``."""
    return F.broadcast(df) if small(df, most) else df
