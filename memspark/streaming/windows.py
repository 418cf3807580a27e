"""Structured Streaming: event-time windows, sessions, duplicates, and ingestion of turns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.session import checkpoint_dir
from memspark.sources import table_path


def read_table(spark: SparkSession, root: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table's Parquet file or folder as a stream of its files."""
    path = table_path(root, name)
    schema = spark.read.parquet(path).schema
    folder, _, leaf = path.rpartition("/")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", leaf).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n_events"))
    return counted.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n_events")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """Events of a user with less than ``gap`` between them."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"))
    return counted.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n_events")


def first_seen(rows: DataFrame, key: str, time: str, late: str = "3650 days") -> DataFrame:
    """Each key once, as long as its state is kept."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def ingest(turns: DataFrame, write) -> object:
    """Each micro-batch of turns through hygiene and classification, handed to ``write(frame, batch)``."""
    from memspark.operators import extract as E

    def batch(df: DataFrame, number: int) -> None:
        text = F.col("user_message")
        out = df.withColumn("h", E.hygiene(text, F.lit("user"))).withColumn("c", E.classify(F.coalesce(text, F.lit("")), F.lit("user")))
        write(out.filter("h.verdict <> 'DISCARD'").select("turn_id", "session_id", "logged_at", "h.verdict", "c.memory_type", "c.confidence"), number)

    at = f"{checkpoint_dir(turns.sparkSession)}/stream-{uuid.uuid4().hex}"
    return turns.writeStream.foreachBatch(batch).option("checkpointLocation", at).trigger(availableNow=True).start()


def run_once(stream: DataFrame) -> DataFrame:
    """All rows a stream gives for what is there now, through a table in the shared folder.

    Results of open windows are written as well: each micro-batch rewrites them (complete mode), or, for streams
    without aggregation, is appended."""
    spark = stream.sparkSession
    out = f"{checkpoint_dir(spark)}/memspark-{uuid.uuid4().hex}"
    aggregated = "Aggregate" in stream._jdf.queryExecution().logical().toString()

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite" if aggregated else "append").parquet(out)

    query = stream.writeStream.outputMode("complete" if aggregated else "append").foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
