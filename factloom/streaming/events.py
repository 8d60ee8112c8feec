"""Structured Streaming forms of the append-only parts: windowed counts and verbatim search over arriving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import passages_in


def stream(spark: SparkSession, path: str, schema, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Events per window and type; rows later than the watermark are dropped. Works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def watch_passages(texts: DataFrame, passages: DataFrame, out: str, checkpoint: str, key: str = "doc_id"):
    """Hits of each micro-batch under ``out`` as ``batch=<id>``; passages are a table. A batch that is run again after a failure
    replaces its own folder, so no hit is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        passages_in(batch, passages, key=key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
