"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import names as N
from memspark.sources import load


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return N.links(load(spark, root, "entities"), load(spark, root, "entity_mentions"))


def p2_parties(spark: SparkSession, root: str) -> DataFrame:
    """One row per registry row with its party and the party's size."""
    table, _ = N.parties(load(spark, root, "entities"))
    return table.join(table.groupBy("party").agg(F.count("*").alias("n_rows")), "party").select("id", "party", "n_rows")


QUERIES = {"p2_found": p2_found, "p2_parties": p2_parties}
SQL: dict[str, str] = {}
