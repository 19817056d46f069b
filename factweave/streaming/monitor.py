"""Monitoring as a stream: an extension, since the batch operators have no notion of time.

Files of an append-only log are read as they come; events are deduplicated within a watermark
and counted per type and hour.  ``availableNow`` drains what is there and stops, so the same
code serves a scheduled run and a test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.store import shared_dir


def events_per_hour(events: DataFrame) -> DataFrame:
    """Counts per hour and type of events distinct by id; late ones within two hours count."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 hour"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("hour"), "event_type", "n", "total")
    )


def monitor(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Run the stream over the files at ``path`` to the end and return its last counts.

    Every batch appends the counts it changed to Parquet under ``out`` (a folder in shared
    storage); of one hour and type the latest batch counts."""
    schema = spark.read.parquet(path).schema
    where, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{where}/{name}*")
    folder = f"{out or shared_dir(spark)}/monitor-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces itself
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    counts = events_per_hour(stream)
    run = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        run.awaitTermination()
        if run.exception() is not None:
            raise run.exception()
    finally:
        run.stop()
    found = spark.read.schema(counts.schema.add("batch", "long")).parquet(f"{folder}/counts")
    return found.groupBy("hour", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("hour", "event_type", "x.n", "x.total")
