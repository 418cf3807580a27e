"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set only where the caller's session has not set them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "memspark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's own session is used."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or by the context's own checkpoint folder.

    Where the session names none, a temporary folder is set, but only if driver and executors are one machine;
    anywhere else that would lose data with an executor, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="memspark-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by writing it as Parquet to the shared checkpoint folder and reading it back.

    The written table outlives lost executors, keeps column pruning and gives the optimiser real sizes."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"memspark-{uuid.uuid4().hex}")
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for this table goes as soon as it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held) if held else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and that nothing reads any more."""
    jvm, files = df.sparkSession.sparkContext._jvm, df.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
