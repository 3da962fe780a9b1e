"""Joins and merges between tables of different origin: containment, unique best matches, boxes, graph edges, provenance, pools, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import tokens
from .scoring import rank_by


def containment_matches(asked: DataFrame, docs: DataFrame, *, query: str, doc: str, text: str = "text", shared: int = 3, least: float = 0.8, gap: float = 0.02) -> DataFrame:
    """query, doc, containment: the text that holds most of a question's words, if it holds enough and is clearly ahead of the next."""
    q = asked.select(query, F.array_distinct(tokens(F.col(text))).alias("_t")).select(query, F.size("_t").alias("_n"), F.explode("_t").alias("_w"))
    d = docs.select(doc, F.explode(F.array_distinct(tokens(F.col(text)))).alias("_w"))
    c = q.join(d, "_w").groupBy(query, doc).agg((F.count("*") / F.first("_n")).alias("_part"), F.count("*").alias("_both")).where(F.col("_both") >= shared)
    o = W.partitionBy(query).orderBy(F.desc("_part"), F.asc(doc))
    r = c.withColumn("_rn", F.row_number().over(o)).withColumn("_next", F.lead("_part").over(o))
    return r.where((F.col("_rn") == 1) & (F.col("_part") >= least) & (F.col("_part") - F.coalesce("_next", F.lit(0.0)) >= gap)).select(query, doc, F.round("_part", 6).alias("containment"))


def unique_best(rows: DataFrame, by: str, score: str) -> DataFrame:
    """The rows that have their group's highest score alone; groups whose best is tied have none."""
    top = rows.withColumn("_top", F.max(score).over(W.partitionBy(by))).withColumn("_ties", F.count("*").over(W.partitionBy(by, score)))
    return top.where((F.col(score) == F.col("_top")) & (F.col("_ties") == 1)).drop("_top", "_ties")


def box_distance(a: str, b: str, side: float = 0.25) -> Column:
    """Vertical gap of two boxes (columns x0, y0, x1, y1 with prefixes a and b) and a part of the horizontal one."""
    gap = lambda p: F.greatest(F.lit(0), F.greatest(F.col(f"{a}{p}0") - F.col(f"{b}{p}1"), F.col(f"{b}{p}0") - F.col(f"{a}{p}1")))
    return gap("y") + side * gap("x")


def boxes_touch(a: str, b: str, margin: float = 2) -> Column:
    near = lambda p: (F.col(f"{a}{p}0") - margin < F.col(f"{b}{p}1")) & (F.col(f"{b}{p}0") - margin < F.col(f"{a}{p}1"))
    return near("x") & near("y")


def label_edges(objects: DataFrame, paper: str, node: str, label: str, kind: str = "same_label") -> DataFrame:
    """type, src, dst between all objects of a paper that have one label, in both directions; empty labels link nothing.

    Groups are a paper's objects of one label, a handful; every pair is an edge of the graph.
    """
    own = objects.where(F.coalesce(F.col(label), F.lit("")) != "")
    a, b = own.select(paper, label, F.col(node).alias("src")), own.select(paper, label, F.col(node).alias("dst"))
    return a.join(b, [paper, label]).where("src <> dst").select(F.lit(kind).alias("type"), "src", "dst")


def caption_edges(captions: DataFrame, objects: DataFrame, paper: str, page: str, node: str, label: str, at: str) -> DataFrame:
    """type, src, dst from captions to the objects of their page with the same label, else to the nearest object by reading order."""
    c = captions.select(paper, page, F.col(node).alias("src"), F.col(label).alias("_l"), F.col(at).alias("_a"))
    rows = c.join(objects.select(paper, page, F.col(node).alias("dst"), F.col(label).alias("_o"), F.col(at).alias("_b")), [paper, page])
    rows = rows.withColumn("_same", F.coalesce(F.col("_l") == F.col("_o"), F.lit(False))).withColumn("_any", F.max("_same").over(W.partitionBy(paper, page, "src")))
    rows = rows.withColumn("_n", rank_by([paper, page, "src"], F.asc(F.abs(F.col("_a") - F.col("_b"))), F.asc("dst")))
    return rows.where(F.when(F.col("_any"), F.col("_same")).otherwise(F.col("_n") == 1)).select(F.lit("caption_of").alias("type"), "src", "dst")


def united(tables: dict[str, DataFrame], *key: str) -> DataFrame:
    """key, sources: the different keys of all tables with the names of those that hold them, sorted."""
    both = reduce(DataFrame.unionByName, [t.select(*key, F.lit(name).alias("_s")) for name, t in tables.items()])
    return both.groupBy(*key).agg(F.array_sort(F.collect_set("_s")).alias("sources"))


def merged_counts(parts: list[DataFrame], by: list[str], n: str = "n") -> DataFrame:
    """Histograms added up."""
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum(n).alias(n))


def retriever_pool(units: DataFrame, by: str, k: int) -> DataFrame:
    """The pool of each question: all its special units, and of the others the k best (by, unit, score, special)."""
    rows = units.withColumn("_rn", rank_by([by, "special"], F.desc("score"), F.asc("unit")))
    return rows.where(F.col("special") | (F.col("_rn") <= k)).drop("_rn")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of a record's fields."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def repeated_contents(rows: DataFrame, columns: list[str], source: str, key: str) -> DataFrame:
    """h, n, sources, first_id of contents that stand in the table more than once."""
    held = rows.select(fingerprint(*columns).alias("h"), source, key)
    return held.groupBy("h").agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"), F.min(key).alias("first_id")).where("n > 1")


def batches(rows: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """rows with `batch`: their number, in order, by so many of a group."""
    return rows.withColumn("batch", F.floor((rank_by(by, F.asc(order)) - 1) / size))
