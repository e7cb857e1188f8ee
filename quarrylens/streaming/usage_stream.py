"""Usage rows as a stream: rollups by command over event-time windows, and appends to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylens import schema


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """New files of a usage table as they arrive."""
    return spark.readStream.schema(schema.USAGE).parquet(path)


def rollup(usage: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """command, window start, invocations and tokens; a window closes once no row of it can be later than allowed."""
    at = F.timestamp_micros(F.floor(F.col("ts_unix_ns") / 1000).cast("long"))
    timed = usage.withColumn("at", at).withWatermark("at", late)
    sums = [F.sum(c).alias(c) for c in ("candidate_bytes", "estimated_baseline_tokens", "returned_tokens")]
    return timed.groupBy(F.window("at", window), "command").agg(F.count(F.lit(1)).alias("invocations"), *sums).select(F.col("window.start").alias("start"), "command", "invocations", *("candidate_bytes", "estimated_baseline_tokens", "returned_tokens"))


def append_rollup(usage: DataFrame, path: str, checkpoint: str, window: str = "1 hour", late: str = "1 day") -> StreamingQuery:
    """Write closed windows to a table; stops when all that has arrived is done."""
    return rollup(usage, window, late).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
