"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import use_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; pruning and pushdown are left to Catalyst."""
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")
