"""Tables that a computation of several steps keeps between them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tonegrid-"))
        held = sc._jsc.sc().getCheckpointDir()
    return str(held.get()).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)


def keep(df: DataFrame) -> DataFrame:
    """The same rows, cut from what they were made of, where all executors reach them.

    Spark deletes a checkpoint once nothing refers to it (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
