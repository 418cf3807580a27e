"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of folder ``root``; projection and filters reach the Parquet scan."""
    return spark.read.parquet(table_path(root, name))
