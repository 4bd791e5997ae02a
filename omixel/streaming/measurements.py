"""Structured Streaming over long measurement rows, for labs that deliver samples as they are measured.

The analysis itself is batch work; what a stream can keep up to date are the counts that decide a feature's tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.numeric import tier


def measurements(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detections(stream: DataFrame, time: str, watermark: str = "1 hour") -> DataFrame:
    """feature, observed: distinct samples with a value, each counted once however often it is delivered within the watermark."""
    seen = stream.filter(F.col("value").isNotNull()).withWatermark(time, watermark).dropDuplicatesWithinWatermark(["sample_id", "feature"])
    return seen.groupBy("feature").agg(F.count("*").alias("observed"))


def windowed_counts(stream: DataFrame, time: str, window: str, by: str, watermark: str = "1 hour") -> DataFrame:
    """Rows per tumbling window and key; late rows beyond the watermark are left out."""
    return stream.withWatermark(time, watermark).groupBy(F.window(time, window).alias("window"), by).agg(F.count("*").alias("n"))


def keep_tiers(detected: DataFrame, n_samples: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every feature's current tier to `path`, a folder per batch; the last one holds the latest state of what changed."""

    def write(batch: DataFrame, number: int) -> None:
        rate = F.lit(1.0) - F.col("observed") / F.lit(n_samples)
        batch.withColumn("rate", rate).withColumn("tier", tier(F.col("rate"))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return detected.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
