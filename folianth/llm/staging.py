"""The driver's tables, and tables staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folianth.sources.staging import staged

__all__ = ["staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
