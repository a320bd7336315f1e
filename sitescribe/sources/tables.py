"""Reading the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as analysis runs: series, time, status and score."""
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("created_at"),
        status.alias("status"), (F.col("o_totalprice") / 5000).alias("score"), F.col("o_orderpriority").alias("priority"),
    )
