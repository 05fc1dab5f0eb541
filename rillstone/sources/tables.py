"""Readers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cluster: work that costs much per row isn't bound to the few tasks that a small file gives."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism))
