"""Structured Streaming over the append-only event log (an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by event type in tumbling windows; events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def tumbling_counts(spark: SparkSession, path: str) -> DataFrame:
    """Run :func:`tumbling` over a parquet log until it is used up; the counts as a table."""
    folder, _, name = path.rpartition("/")  # a stream reads folders
    root = f"{shared_folder(spark)}/tessera-stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    run = tumbling(stream).writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    changed = spark.read.option("recursiveFileLookup", "true").schema("w struct<start: timestamp, end: timestamp>, event_type string, n long").parquet(f"{root}/out")
    return changed.groupBy(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.max("n").alias("n"))
