"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import pii as P
from memspark.sources import load


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return P.memory_texts(load(spark, root, "memory_blocks"), load(spark, root, "turns"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return P.items(_texts(spark, root))


def p5_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Under the secret of the session's ``spark.memspark.pii.key``, or a new one for each run."""
    key = spark.conf.get("spark.memspark.pii.key", None)
    return P.redacted(_texts(spark, root), key.encode() if key else None)


QUERIES = {"p5_found": p5_found, "p5_redacted": p5_redacted}
SQL: dict[str, str] = {}
