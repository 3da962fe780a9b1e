"""What an output was made from: digests of input files as a hash tree, manifests that a resumed run must match, and cached artifacts that may be used again."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VERSION = 1
#: Fixed value: files that hold gold labels and are no input of an inference.
GOLD_FILES = ("validation.jsonl",)
#: Files of a source are combined in so many parts before these are.
PARTS = 256
#: Names that Spark's writers leave beside the data, with other content in each run.
_MARKS = r"/(?:_SUCCESS|_committed_[^/]*|_started_[^/]*|\.[^/]*)$"


def file_digests(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """source, name (below the source's path), bytes, sha256 of every file of the sources, each a file or a folder, read by Spark.

    A file must be smaller than two gigabytes. Marks of finished writes and hidden files don't count.
    """
    one = lambda source, path: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lit(source).alias("source"), _below("path", path).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("path").rlike(_MARKS).alias("_mark"))
    return reduce(DataFrame.unionByName, [one(s, p) for s, p in sources.items()]).where("NOT _mark").drop("_mark")


def _below(path: str, root: str) -> Column:
    """What stands behind the root in a path; the whole last part for a root that is a file."""
    flat = F.regexp_replace(path, r"^[a-z0-9]+:/*", "/")
    start = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9]+:/*", "/")
    return F.coalesce(F.nullif(F.regexp_replace(F.when(flat.startswith(start), F.substr(flat, F.length(start) + 1)).otherwise(flat), "^/+", ""), F.lit("")), F.regexp_extract(flat, "([^/]*)$", 1))


def tree_digests(files: DataFrame) -> DataFrame:
    """source, files, bytes, sha256: one digest over all files of a source, which tells names, sizes and contents.

    Files are combined by the first byte of their name's digest, then the parts in order, so that no task holds more than a part's names.
    """
    leaf = F.concat_ws(" ", "name", "bytes", "sha256")
    part = F.substring(F.sha2("name", 256), 1, 2)
    parts = files.groupBy("source", part.alias("part")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), "\n"), 256).alias("own"))
    rows = F.array_sort(F.collect_list(F.concat_ws(" ", "part", "own")))  # PARTS rows at most
    return parts.groupBy("source").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(rows, "\n"), 256).alias("sha256"))


def build_manifest(spark: SparkSession, sources: dict[str, str | None], parameters: dict) -> dict:
    """What an inference is made from: each source's path and digest, and the parameters. Sources without a path are left out.

    Refuses gold labels, whether a source is such a file or a folder that holds one.
    """
    given = {s: p for s, p in sources.items() if p}
    files = file_digests(spark, given)
    gold = files.where(F.regexp_extract("name", "([^/]*)$", 1).isin(*GOLD_FILES)).select("source").distinct().limit(1).collect()
    if gold or any(p.rstrip("/").rsplit("/", 1)[-1] in GOLD_FILES for p in given.values()):
        raise ValueError(f"gold labels are no input of an inference: {gold[0][0] if gold else sorted(given.values())}")
    own = {r["source"]: {"path": given[r["source"]], "files": r["files"], "bytes": r["bytes"], "sha256": r["sha256"]} for r in tree_digests(files).collect()}  # a row for each source
    return json.loads(json.dumps({"version": VERSION, "inference_inputs_only": True, "refused": list(GOLD_FILES), "sources": own, "parameters": parameters}))


def _exists(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def read_manifest(spark: SparkSession, output: str) -> dict | None:
    path = f"{output.rstrip('/')}/provenance"
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0]) if _exists(spark, f"{path}/_SUCCESS") else None


def write_or_validate(spark: SparkSession, output: str, manifest: dict, *, resume: bool) -> None:
    """Puts the manifest beside an output. A resumed run must have the manifest that is there; otherwise it is refused, with the names of what differs, and nothing is written."""
    held = read_manifest(spark, output) if resume else None
    if held is not None:
        if held != manifest:
            own = lambda m: {**{f"source {s}": x for s, x in m.get("sources", {}).items()}, **{f"parameter {p}": x for p, x in m.get("parameters", {}).items()}, "version": m.get("version")}
            a, b = own(held), own(manifest)
            raise ValueError(f"not resumed: {', '.join(sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k)))} changed since {output} was begun; use a new folder or remove the old output")
        return
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{output.rstrip('/')}/provenance")


def reusable(wanted: DataFrame, cached: DataFrame, versions: list[str], *, keys: list[str], partial: bool = False, lenient: tuple[str, ...] = ()) -> DataFrame:
    """wanted with reuse: whether a cached artifact of its keys has the wanted versions, has content and is complete (partial: or partial).

    cached: keys, versions, status, bytes. Several artifacts of a key: one that fits is enough. `lenient` versions also fit where the artifact doesn't
    tell its own. A wanted version that is null fits none.
    """
    states = ["complete", "partial"] if partial else ["complete"]
    good = cached.where(F.col("status").isin(*states) & (F.coalesce("bytes", F.lit(0)) > 0)).select(*keys, *[F.col(v).alias(f"_{v}") for v in versions])
    fits = F.lit(True)
    for v in versions:
        same = F.col(v) == F.col(f"_{v}")
        fits = fits & (same | (F.col(f"_{v}").isNull() | (F.col(f"_{v}") == 0) if v in lenient else F.lit(False)))
    hit = wanted.select(*keys, *versions).distinct().join(good, keys).where(F.coalesce(fits, F.lit(False))).select(*keys, *versions).distinct().withColumn("_hit", F.lit(True))
    left, right = wanted.alias("w"), hit.alias("h")
    on = reduce(lambda a, b: a & b, [F.col(f"w.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*keys, *versions]])
    return left.join(right, on, "left").select("w.*", F.coalesce("h._hit", F.lit(False)).alias("reuse"))


def report(spark: SparkSession, stats: dict, paths: dict[str, str]) -> DataFrame:
    """name, value (texts, sorted by name): the statistics of a run and the rows of its JSON Lines and Parquet outputs, counted from the files."""
    rows = {f"{name}_rows": spark.read.text(p).where(F.trim("value") != "").count() if p.endswith((".jsonl", ".json")) else spark.read.parquet(p).count() for name, p in paths.items()}
    return spark.createDataFrame(sorted((k, json.dumps(v)) for k, v in (stats | rows).items()), "name string, value string")
