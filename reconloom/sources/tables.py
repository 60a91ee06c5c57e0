"""Loading the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reconloom.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder; Catalyst prunes columns and pushes filters into the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
