"""Sources and sinks besides tables: session datasets, reports, leaderboards, logs, checkpoints of runs, ingestion keys."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An evaluation instance: a question, its answer, and the sessions to replay.
INSTANCE = ("question string, answer string, question_type string, haystack_sessions array<array<struct<role: string, content: string>>>")


def resolve(path: str, *folders: str) -> str:
    """An absolute path as it is; a relative one in the working directory, else in the first folder that has it."""
    if os.path.isabs(path):
        return path
    for folder in (os.getcwd(), *folders):
        if os.path.exists(os.path.join(folder, path)):
            return os.path.join(folder, path)
    return path


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or a folder of such files, of evaluation instances."""
    return spark.read.schema(INSTANCE).json(path, multiLine=True)


def session_turns(instances: DataFrame) -> DataFrame:
    """Instances flattened to turns: question, session (from 0), turn (from 0), role, content; blank turns are left out."""
    s = instances.select("question", F.posexplode("haystack_sessions").alias("session", "turns"))
    t = s.select("question", "session", F.posexplode("turns").alias("turn", "m"))
    return t.select("question", "session", "turn", "m.role", "m.content").filter(F.trim("content") != "")


def ingestion_key(sessions: Column, ablation: Column) -> Column:
    """Key of a replay: the same sessions and ablation give the same 16 characters."""
    return F.substring(F.sha2(F.concat_ws("|", F.to_json(F.struct(sessions.alias("sessions"))), ablation), 256), 1, 16)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_leaderboard(runs: DataFrame, path: str) -> None:
    """One CSV file with a header, best accuracy first: a leaderboard has one row per run."""
    runs.orderBy(F.desc("accuracy"), "run").coalesce(1).write.mode("overwrite").csv(path, header=True)


def pending(runs: DataFrame, completed: DataFrame) -> DataFrame:
    """Runs that are not among the completed ones."""
    return runs.join(completed.select("run").distinct(), "run", "left_anti")


def append_history(history: DataFrame, new: DataFrame, keep: int = 50) -> DataFrame:
    """The latest ``keep`` runs of both, newest first."""
    return history.unionByName(new, allowMissingColumns=True).orderBy(F.desc("ended_at"), "run").limit(keep)


def reports(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Report files, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def progress(lines: DataFrame) -> DataFrame:
    """The last ``Question a/b`` of numbered lines (n, line): done, total."""
    at = lines.select("n", F.regexp_extract("line", r"Question (\d+)/(\d+)", 1).alias("a"), F.regexp_extract("line", r"Question (\d+)/(\d+)", 2).alias("b")).filter("a <> ''")
    return at.agg(F.max_by("a", "n").cast("int").alias("done"), F.max_by("b", "n").cast("int").alias("total"))
