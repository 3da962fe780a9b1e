"""Session factory and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "evidentia") -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EVIDENTIA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's reader touches the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df written as Parquet to the folder in spark.checkpoint.dir, which driver and executors share, and read back: what is used more than once is made once.

    Where the setting is missing a local session gets a temporary folder; elsewhere it must be set. `rows` is the most that a file holds (0: no bound):
    Spark counts a file as spark.sql.files.openCostInBytes more than it has, so a task gets few small ones, and one that deals its rows,
    which it holds until all are read, holds as much at any size of the table. Without it a task's share is 128 MB of compressed rows.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/evidentia-{name}-{uuid.uuid4().hex}"
    (df.write.option("maxRecordsPerFile", rows) if rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over all cores by a key: work of many expressions a row would else be done by as few tasks as the rows have small files."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *by)


def dealt_by_size(df: DataFrame, rows: int, each: int, *by: str) -> DataFrame:
    """df dealt by a key into parts of about `each` rows, when it has so many: what one task holds then doesn't grow with the input."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // each + 1), *by)
