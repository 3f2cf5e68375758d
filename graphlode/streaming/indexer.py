"""Incremental indexing as streams: every micro-batch is diffed, extracted and merged; the checkpoint follows the write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphlode.functions import names
from graphlode.operators.index import index_project
from graphlode.operators.mutate import last_wins
from graphlode.plans.session import exists, recover, swap
from graphlode.sources.scan import skipped
from graphlode.sources.store import Store

_BINARY = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def watch_tree(spark: SparkSession, store: Store, root: str, project: str, checkpoint: str, files_per_batch: int = 50) -> StreamingQuery:
    """Index the files that appear under a root, ``files_per_batch`` at a time, until all that is there is done.

    Known files that a batch does not hold keep their rows. The stream's checkpoint advances only after a batch's graph and hashes
    are written, and writing a batch again gives the same tables, so a restart neither loses nor doubles anything.
    """
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(root)
    base = root.rstrip("/")

    def merge(batch: DataFrame, _: int) -> None:
        relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/+", "/"), f"^{base}/", "")
        rows = batch.select(F.lit(project).alias("project"), relative.alias("path"), names.decode(F.col("content")).alias("text"), F.sha2("content", 256).alias("sha256"), "modificationTime")
        rows = last_wins(rows.where(~skipped(F.col("path"))), ["project", "path"], ["modificationTime"]).drop("modificationTime")
        merge_batch(store, rows, project)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batch(store: Store, rows: DataFrame, project: str) -> None:
    """Index the batch together with what is known: unchanged files come as their stored hash, without text."""
    known = store.hashes().where(F.col("project") == project).join(rows.select("path"), "path", "left_anti")
    index_project(store, rows.unionByName(known.select("project", "path", F.lit(None).cast("string").alias("text"), "sha256")), project)


def latest_by_key(stream: DataFrame, key: list[str], order: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key of a stream in a Parquet table: last wins inside a batch and against the table."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        recover(spark, target)
        if exists(spark, target):
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(target))
        # written beside the table and then put in its place: a failed batch leaves the old one
        beside = f"{target}-batch-{batch_id}"
        last_wins(batch, key, order).write.mode("overwrite").parquet(beside)
        swap(spark, beside, target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time_col: str, key: str, width: str, lateness: str) -> DataFrame:
    """(window_start, key, n): event counts of tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
