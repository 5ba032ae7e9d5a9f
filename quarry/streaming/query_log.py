"""Query log as a stream (an extension): records that arrive as JSON files are appended in micro-batches, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.telemetry import LOG_SCHEMA


def log_stream(spark: SparkSession, folder: str, files_a_batch: int = 50) -> DataFrame:
    """Records from the JSON files of a folder, as they arrive."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)


def append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the stream to a log in folders by day; the checkpoint makes a batch count once."""
    writer = stream.withColumn("day", F.to_date("logged_at")).writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def rates(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Queries, errors and mean latency by window; records later than `late` are left out."""
    return stream.withWatermark("logged_at", late).groupBy(F.window("logged_at", window)).agg(F.count(F.lit(1)).alias("queries"), F.sum(F.col("had_error").cast("int")).alias("errors"), F.avg("total_ms").alias("avg_ms"))
