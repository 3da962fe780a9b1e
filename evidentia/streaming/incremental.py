"""Incremental processing: stage files as streams, resumed by checkpoint; the last row of a key wins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stage_stream(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a stage folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_new(rows: DataFrame, key: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends rows of keys not seen before and stops when all there is has been read; a rerun goes on where it ended."""
    return rows.dropDuplicates([key]).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest order."""
    own = F.struct(order, *[c for c in rows.columns if c != order])
    return rows.groupBy(key).agg(F.max(own).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns])


def _fs(spark: SparkSession, path: str):
    """A path and its Hadoop file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, sink: str) -> dict[int, dict]:
    """The commits of an upsert() sink by number: each tells its batch, and the generation in which every bucket was last written."""
    root, fs = _fs(spark, f"{sink}/commits")
    found = sorted(str(s.getPath().getName()) for s in fs.listStatus(root)) if fs.exists(root) else []
    return {int(name): json.loads(spark.read.option("wholetext", True).text(f"{sink}/commits/{name}").first()[0]) for name in found[-1:]}


def merge_batch(batch: DataFrame, number: int, key: str, order: str, sink: str, buckets: int) -> None:
    """Merges one batch into the sink: only buckets that hold a key of the batch are read and written, in a new generation of files.

    The commit is one rename, so a reader sees all of a batch or nothing, and files of other buckets stay as they are.
    A batch whose number is not above the last commit's has been merged before and changes nothing; files that a lost
    run left without a commit are written over by the next one.
    """
    spark = batch.sparkSession
    held = commits(spark, sink)
    last = max(held, default=-1)
    live = held[last]["live"] if held else {}
    if held and (held[last]["buckets"] != buckets or number <= held[last]["batch"]):
        if held[last]["buckets"] != buckets:
            raise ValueError(f"{sink} has {held[last]['buckets']} buckets, not {buckets}")
        return
    new = latest(batch, key, order).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
    try:
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # bucket numbers
        old = [f"{sink}/rows/g{live[str(k)]:08d}/_bucket={k}" for k in touched if str(k) in live]
        both = new.drop("_bucket")
        if old:
            both = both.unionByName(spark.read.schema(both.schema).parquet(*old))
        merged = latest(both, key, order).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        merged.repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{sink}/rows/g{last + 1:08d}")
    finally:
        new.unpersist()
    note = json.dumps({"batch": number, "buckets": buckets, "live": live | {str(k): last + 1 for k in touched}, "schema": batch.schema.jsonValue()})
    made = f"{sink}/_made-{last + 1:08d}"
    spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("overwrite").text(made)
    root, fs = _fs(spark, f"{sink}/commits")
    fs.mkdirs(root)
    if not fs.rename(_fs(spark, made)[0], _fs(spark, f"{sink}/commits/{last + 1:08d}")[0]):
        raise RuntimeError(f"commit {last + 1} of {sink} is there already: the sink has another writer")


def upsert(rows: DataFrame, key: str, order: str, sink: str, checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key in `sink`, dealt by key into buckets of which a batch rewrites those it touches; read it with current()."""
    return rows.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, key, order, sink, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str) -> DataFrame | None:
    """The rows of an upsert() sink as of its last commit; None before the first."""
    held = commits(spark, sink)
    if not held:
        return None
    note = next(iter(held.values()))
    schema = StructType.fromJson(note["schema"])
    paths = [f"{sink}/rows/g{g:08d}/_bucket={k}" for k, g in note["live"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per event type and time window with a watermark: an addition, for streams with event time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
