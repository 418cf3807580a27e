"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import leaks as L
from memspark.sources import load


def _found(spark: SparkSession, root: str) -> DataFrame:
    return L.find(load(spark, root, "documents"), load(spark, root, "eval_items"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _found(spark, root).filter(F.col("run_words") >= L.RUN_WORDS).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, root: str) -> DataFrame:
    """Leaked items: documents that contain or nearly contain their wording, and the longest shared run."""
    exact = F.col("run_words") >= L.RUN_WORDS
    one = _found(spark, root).groupBy("item_id", "part", "doc_id").agg(F.max("run_words").alias("run_words"))
    return one.groupBy("item_id", "part").agg(F.count_if(exact).alias("n_exact"), F.count("*").alias("n_near"), F.max("run_words").alias("longest_run"))


QUERIES = {"p6_found": p6_found, "p6_items": p6_items}
SQL: dict[str, str] = {}
