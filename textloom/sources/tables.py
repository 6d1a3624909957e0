"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; filters and columns are pushed into the scan."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
