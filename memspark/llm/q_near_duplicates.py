"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import near_duplicates as N
from memspark.sources import load

#: As TESTDATA.md sets them for this problem.
THRESHOLD, MIN_WORDS = 0.6, 12


def _docs(spark: SparkSession, root: str) -> DataFrame:
    blocks = load(spark, root, "memory_blocks")
    return blocks.select("id", F.explode(F.create_map(F.lit("content"), "content", F.lit("summary"), "summary")).alias("field", "text"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return N.pairs(*N.links(_docs(spark, root), THRESHOLD, MIN_WORDS))


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    found, members = N.links(_docs(spark, root), THRESHOLD, MIN_WORDS)
    return N.groups(found, members)


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
SQL: dict[str, str] = {}
