"""Incremental forms: append of new works, snapshots that grow, and edges kept over a stream of works."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.operators.blocks import unfold_pairs
from corpusloom.session import cut


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream; time stamps without a zone are taken as UTC in a session so set."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a later run with the same checkpoint takes up where this one ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 64) -> StreamingQuery:
    """Append rows whose key is not yet in ``target``.

    The keys that are there stand beside the rows, in ``target``/_keys, in ``buckets`` folders by their
    hash; a batch reads only the key column of the folders that its own keys fall into, never the rows.
    A batch that is repeated after a failure overwrites its own folders, so nothing comes twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = cut(batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")))
        earlier, fresh = f"{target}/_keys", dealt
        path = spark._jvm.org.apache.hadoop.fs.Path(earlier)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            asked = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
            schema = f"`{key}` {dealt.schema[key].dataType.simpleString()}, bucket int, batch_no bigint"
            done = spark.read.schema(schema).parquet(earlier).where(F.col("bucket").isin(asked) & (F.col("batch_no") < number))
            fresh = cut(dealt.join(done.select(key), key, "left_anti"))
        transform(fresh.drop("bucket")).write.mode("overwrite").parquet(f"{target}/batch_no={number}")
        keys = fresh.select(key, "bucket", F.lit(number).cast("bigint").alias("batch_no"))
        keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no", "bucket").parquet(earlier)

    return run_once(stream, checkpoint, each)


def running_counts(stream: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """(window_start, key, n) of tumbling windows; rows later than ``late`` are left out."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n")


def streamed_edges(stream: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """(work_id, u, v, published) of a stream of works with ``cids``; a work that comes again within ``late`` counts once."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["work_id"])
    lists = once.select("work_id", F.col(time).alias("published"), F.array_sort(F.array_distinct("cids")).alias("cids"))
    return unfold_pairs(lists, "cids", "work_id", "published").select("work_id", "published", "u", "v")
