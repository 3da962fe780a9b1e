"""Official metrics, funnels, validation and comparison of prediction sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.labels import cell_equal
from ..functions.text import normalize_answer
from ..session import dealt_by_size
from .scoring import nearest_ranks, precision_recall

#: Rows of tables that meet in one task.
PART = 250_000


def macro(per_key: DataFrame) -> DataFrame:
    """Means of precision, recall, F1 over the keys; null without any."""
    return per_key.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("n"))


def table_scores(gold: DataFrame, pred: DataFrame, by: str, key: str, columns: dict[str, str]) -> DataFrame:
    """by, row precision, recall, f1, cells correct and in all. Rows of equal normalised key: the last by `line` wins."""
    side = lambda df, of: df.where(F.col(by).isNotNull()).select(by, normalize_answer(F.col(key)).alias("_key"), "line", *[F.col(c).cast("string").alias(f"_{c}") for c in columns], F.lit(of).alias("_side"))
    both = dealt_by_size(side(gold, "g").unionByName(side(pred, "p")), gold.count() + pred.count(), PART, by, "_key")
    both = both.withColumn("_rn", F.row_number().over(W.partitionBy(by, "_key", "_side").orderBy(F.desc("line")))).where("_rn = 1")
    cells = F.struct(*[F.col(f"_{c}").alias(c) for c in columns])
    rows = both.groupBy(by, "_key").agg(*[F.first(F.when(F.col("_side") == x, cells), ignorenulls=True).alias(x) for x in "gp"])  # sorted by the window already
    known, g, p = F.col("_key").isNotNull(), F.col("g").isNotNull(), F.col("p").isNotNull()
    right = sum(((known & g & p & cell_equal(F.col(f"g.{c}"), F.col(f"p.{c}"), F.lit(kind))).cast("long") for c, kind in columns.items()), F.lit(0).cast("long"))
    sums = rows.groupBy(by).agg(F.count_if(g & known).alias("_g"), F.count_if(p & known).alias("_p"), F.count_if(g & p & known).alias("_c"), F.sum(right).alias("cell_correct"), (F.count_if(g) * len(columns)).alias("cell_total")).where("cell_total > 0")
    return sums.select(by, *precision_recall(F.col("_g"), F.col("_p"), F.col("_c")), "cell_correct", "cell_total")


def rank_metrics(hits: DataFrame, by: str, k: int) -> DataFrame:
    """One row over hits (by, rank, relevant): recall at k, share of keys with all and with any in the first k, mean reciprocal rank, median and 0.9 nearest rank of first hits."""
    per = hits.where("relevant").groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"))
    high = nearest_ranks(per.withColumn("_all", F.lit(1)), "_all", "first", {"p90_rank": 0.9})  # one row
    out = per.agg(
        F.round(F.avg(F.col("found") / F.col("n")), 6).alias("recall"),
        F.round(F.avg((F.col("found") == F.col("n")).cast("int")), 6).alias("full_coverage"),
        F.round(F.avg((F.col("found") > 0).cast("int")), 6).alias("any_hit"),
        F.round(F.avg(F.lit(1.0) / F.col("first")), 6).alias("mrr"),
        F.percentile("first", F.lit(0.5)).alias("median_rank"),
    )
    return out.withColumn("_all", F.lit(1)).join(high.withColumn("p90_rank", F.col("p90_rank").cast("long")), "_all", "left").drop("_all")


#: Stages of the funnel, in order; the first that fails names the failure.
LADDER = (("candidate", "candidate_missing"), ("available", "pdf_unavailable"), ("page", "page_not_found"), ("typed", "source_type_not_extracted"), ("located", "locator_mismatch"), ("chosen", "not_selected"))


def failure_stage(flags: dict[str, Column]) -> Column:
    out = None
    for flag, name in LADDER:
        out = F.when(~flags[flag], name) if out is None else out.when(~flags[flag], name)
    return out.otherwise("selected")


def funnel(rows: DataFrame, dimensions: list[str], flags: list[str]) -> DataFrame:
    """Counts and shares of each flag over all rows and by each dimension, as grouping sets; `dimension` tells which."""
    total = [F.count("*").alias("n"), *[F.round(F.avg(F.col(f).cast("int")), 6).alias(f) for f in flags]]
    sets = rows.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(*total, *[F.grouping(d).alias(f"_{d}") for d in dimensions])
    name, value = F.lit("all"), F.lit(None).cast("string")
    for d in dimensions:
        name, value = F.when(F.col(f"_{d}") == 0, d).otherwise(name), F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "n", *flags)


def violations(*rules: tuple[str, DataFrame, Column]) -> DataFrame:
    """(key, rule) of all rules: each a name, the offending rows and their key."""
    out = None
    for name, rows, key in rules:
        own = rows.select(key.cast("string").alias("key"), F.lit(name).alias("rule"))
        out = own if out is None else out.unionByName(own)
    return out
