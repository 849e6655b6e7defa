"""Streaming jobs: records masked as they arrive, events counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators.counted import mask_by_counts


def _exactly(path: str) -> str:
    """A pattern that this path alone matches, as a stream of one file is read by a pattern."""
    return f"{path[:-1]}[{path[-1]}]"


def stream_mask(spark: SparkSession, source: str, index: DataFrame, folder: str, k: int, threshold: int, files: int = 100) -> DataFrame:
    """rec_id, start_pos, end_pos, hits: regions of the records in the Parquet file or folder `source`, micro-batch by micro-batch.

    Each batch is masked by the static index and written under its number, so that a batch that is run again replaces
    itself; progress is kept in the folder. Ends when all files there are read. A record sent again is masked again, so
    equal regions count once.
    """
    index.where(F.col("cnt") >= threshold).write.mode("overwrite").parquet(f"{folder}/index")
    fixed = spark.read.parquet(f"{folder}/index")
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(_exactly(source))

    def mask(batch: DataFrame, number: int) -> None:
        # the first by sequence, so that reading the batch again gives the same rows
        first = W.partitionBy("rec_id").orderBy("seq")
        once = batch.where("rec_id IS NOT NULL").select("rec_id", "seq").withColumn("_n", F.row_number().over(first)).where("_n = 1")
        mask_by_counts(once, k, threshold, threshold, index=fixed).write.mode("overwrite").parquet(f"{folder}/regions/batch={number}")

    q = rows.writeStream.foreachBatch(mask).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("rec_id long, start_pos long, end_pos long, hits long, batch int").parquet(f"{folder}/regions").drop("batch").distinct()


def stream_windows(spark: SparkSession, source: str, folder: str, window: str = "1 hour", late: str = "400 days") -> DataFrame:
    """hour, event_type, events: counts of events by window; rows later than the watermark are left out.

    Each micro-batch writes the windows that it changed, under its number; the last count of a window holds. State of
    windows older than the watermark is dropped. The watermark is wide, since files of a folder come in no order of
    time. Rows without a time are left out.
    """
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(_exactly(source)).where("ts IS NOT NULL").withColumn("at", F.col("ts").cast("timestamp"))
    counts = rows.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("events"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema("w struct<start:timestamp,end:timestamp>, event_type string, events long, batch long").parquet(f"{folder}/counts")
    last = rows.groupBy("w.start", "event_type").agg(F.max_by("events", "batch").alias("events"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "events")
