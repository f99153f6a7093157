"""Progress of append-only logs as Structured Streaming."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hintloom.lineage import checkpoint_dir


def progress(events: DataFrame, ts: str, value: str, *by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and group; works on a batch and, with a watermark, on a stream."""
    stamped = events.withColumn("_at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def band(empty: Column, ready: int = 100, close: int = 500) -> Column:
    """How far a run with so many empty outputs is."""
    return F.when(empty < ready, "ready").when(empty < close, "close").otherwise("far")


def wait_step(outputs: DataFrame, text: str, ready: int = 100) -> tuple[int, bool]:
    """The number of empty outputs and whether the next stage may start."""
    n = outputs.where(F.coalesce(F.trim(F.col(text)), F.lit("")) == "").count()
    return n, n < ready


def append_stream(spark: SparkSession, schema, source: str, target: str, checkpoint: str, keep: Column | None = None) -> None:
    """Moves what is new in a folder of JSON lines to a Parquet table, once each; a restart goes on where the checkpoint says."""
    rows = spark.readStream.schema(schema).json(source)
    rows = rows if keep is None else rows.where(keep)
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily progress of the events table, computed by a stream that reads all there is and ends; results lie in the shared folder."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source if os.path.isdir(source) else f"{sf_dir}/events*.parquet")
    root = f"{checkpoint_dir(spark)}/progress-{uuid.uuid4().hex}"
    counted = progress(stream, "ts", "value", "event_type")
    rows = counted.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result")

    query = rows.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/result")
