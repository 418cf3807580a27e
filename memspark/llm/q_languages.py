"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import languages as L
from memspark.sources import load


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return L.cases(L.identify(load(spark, root, "documents")))


def p8_segments(spark: SparkSession, root: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return L.identify(load(spark, root, "documents")).withColumn("confidence", F.round("confidence", 4)).select("doc_id", "seg_no", "start", "end", "lang", "confidence")


QUERIES = {"p8_found": p8_found, "p8_segments": p8_segments}
SQL: dict[str, str] = {}
