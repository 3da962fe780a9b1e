"""JSON Lines: strict scans, sinks, and stage tables with manifests."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; blank lines are skipped, a line that is no object of the schema fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | ~F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")
    checked = lines.select(F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200)))).otherwise(F.col("value")).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def find_file(root: str, name: str) -> str:
    """`root/data/name` if it is there, else `root/name`."""
    for p in (Path(root) / "data" / name, Path(root) / name):
        if p.exists():
            return str(p)
    raise FileNotFoundError(f"{name} is neither in {root}/data nor in {root}")


def write_stage(df: DataFrame, path: str, parameters: dict) -> None:
    """A stage table with a manifest of its parameters and columns."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    manifest = json.dumps({"parameters": parameters, "schema": df.schema.simpleString()}, sort_keys=True)
    df.sparkSession.createDataFrame([(manifest,)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_stage(spark: SparkSession, path: str, parameters: dict) -> DataFrame:
    """A stage table; refuses one that was written with other parameters."""
    held = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if held["parameters"] != json.loads(json.dumps(parameters)):
        raise ValueError(f"stage {path} was written with {held['parameters']}, not {parameters}")
    return spark.read.parquet(f"{path}/rows")


def replay(spark: SparkSession, raw: str, path: str, parameters: dict, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage made again from the raw table of an earlier one, without running what made that; written as a stage and read back."""
    write_stage(step(spark.read.parquet(f"{raw}/rows")), path, parameters)
    return read_stage(spark, path, parameters)


@contextmanager
def output_lock(spark: SparkSession, folder: str) -> Iterator[str]:
    """Holds a folder for one writer: a file that only one can create, in any Hadoop file system; deleted at the end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/.run.lock")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.createNewFile(path):
        raise RuntimeError(f"output folder is already in use: {folder}")
    try:
        yield str(path)
    finally:
        system.delete(path, False)


def unique_by(df: DataFrame, key: str) -> DataFrame:
    """df, failing when it is read if a key is null or stands there twice. Counts by key, so one shuffle."""
    twice = df.groupBy(key).agg(F.count("*").alias("_n"))
    checked = twice.select(F.when(F.col(key).isNull() | (F.col("_n") > 1), F.raise_error(F.concat(F.lit("key missing or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(key)).alias(key))
    return df.join(checked, key)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among keys: what is still to do, or a table after deletion."""
    return df.join(keys.select(key).distinct(), key, "left_anti")
