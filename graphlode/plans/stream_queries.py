"""Streams over the driver's tables, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphlode.plans.registry import Registry
from graphlode.plans.session import ensure_checkpoint_dir, ship
from graphlode.streaming import indexer

query = Registry()


def _folder(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files."""
    ship(spark)
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@query("SELECT project, rel_type, src_key, dst_key, max(step_index) AS step_index FROM edges GROUP BY ALL")
def t_last_wins(spark, sf_dir):
    folder = _folder(spark)
    rows = _stream(spark, sf_dir, "edges").select("project", "rel_type", "src_key", "dst_key", "step_index")
    indexer.latest_by_key(rows, ["project", "rel_type", "src_key", "dst_key"], ["step_index"], f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t_windowed_counts(spark, sf_dir):
    folder = _folder(spark)
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = indexer.windowed_counts(events, "ts", "event_type", "1 hour", "3650 days")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/table").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES, ORACLES = query.queries, query.oracles
