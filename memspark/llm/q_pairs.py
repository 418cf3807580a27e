"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import pairs as P
from memspark.sources import load


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return P.defects(load(spark, root, "turns"), load(spark, root, "documents"))


def p4_by_model(spark: SparkSession, root: str) -> DataFrame:
    """Defects per provider and model."""
    turns = load(spark, root, "turns").select("turn_id", "provider", "model").groupBy("turn_id").agg(F.min("provider").alias("provider"), F.min("model").alias("model"))
    return turns.join(p4_found(spark, root), "turn_id").groupBy("provider", "model", "defect").agg(F.count("*").alias("n_turns"))


QUERIES = {"p4_found": p4_found, "p4_by_model": p4_by_model}
SQL: dict[str, str] = {}
