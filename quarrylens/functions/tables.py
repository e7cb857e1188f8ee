"""Intermediate tables in the folder that all nodes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder serves a local master, as in tests; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    path = tempfile.mkdtemp(prefix="quarry-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again; the lineage ends there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quarry-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], column: str, label: str = "numbered") -> DataFrame:
    """df with the place of each row in an order, from 0: rows are dealt by range, and counted by part; the driver holds one number a part."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_rows = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = cut(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn(column, within), label)
    begin, starts = 0, []
    for r in sorted(held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r._part, begin))
        begin += r.n
    starts = df.sparkSession.createDataFrame(starts, "_part int, _begin long")
    return held.join(F.broadcast(starts), "_part").withColumn(column, F.col(column) + F.col("_begin")).drop("_part", "_begin")  # one row a part


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over all tasks of the session by a hash of keys: small files with much work a row would be few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 4 * spark.sparkContext.defaultParallelism), *keys)
