"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import mixing as M
from memspark.sources import load


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return M.mix(load(spark, root, "documents"), load(spark, root, "source_weights"))[1]


def p7_mixture(spark: SparkSession, root: str) -> DataFrame:
    return M.mix(load(spark, root, "documents"), load(spark, root, "source_weights"))[0]


def p7_soft_shares(spark: SparkSession, root: str) -> DataFrame:
    """Expected shares where the words of the texts decide, whatever their source says."""
    return M.mix(load(spark, root, "documents"), load(spark, root, "source_weights"), membership="text")[1]


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_soft_shares": p7_soft_shares}
SQL: dict[str, str] = {}
