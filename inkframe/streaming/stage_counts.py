"""Diagnostic counts over a stream of events: an extension, with the batch operator's stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.functions import scalars as S


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_stage_counts(events: DataFrame, code: str = "event_type", at: str = "ts", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and stage the number of diagnostics; rows later than the watermark are dropped, state is bounded by it.

    Works on a stream and on a batch alike.
    """
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    stage = S.diagnostic_stage(F.lit(None).cast("string"), F.col(code))
    counts = timed.groupBy(F.window("__at", window).alias("w"), stage.alias("stage")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "stage", "n")
