"""Budgeted and coverage-aware selection. What follows one total order is windows; greedy loops are grouped pandas functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scoring import rank_by


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order (which should be total)."""
    return df.withColumn("_rn", rank_by(keys, *order)).where("_rn = 1").drop("_rn")


def char_prefix(df: DataFrame, by: list[str], size: str, limit: int, *order: Column) -> DataFrame:
    """Rows in order while their sizes together stay within limit; the first row always, and whether the group was cut."""
    w = W.partitionBy(*by)
    rows = df.withColumn("_sum", F.sum(size).over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.sum(size).over(w) > limit)
    return rows.where((F.col("_sum") <= limit) | (F.col("_rn") == 1)).drop("_sum", "_rn")


def type_quota(df: DataFrame, by: list[str], kind: str, per_kind: int, total: int, *order: Column) -> DataFrame:
    """At most per_kind rows of each kind first, then the best others, total in all, with their place."""
    rows = df.withColumn("_k", rank_by([*by, kind], *order)).withColumn("_late", (F.col("_k") > per_kind).cast("int"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("_late", *order)).cast("long")).where(F.col("place") <= total).drop("_k", "_late")


def top1_quota(df: DataFrame, by: list[str], is_top: str, least: int, total: int) -> DataFrame:
    """The best `total` rows by rank, with at least `least` of those with is_top (as many as there are), the worst others giving way."""
    w = W.partitionBy(*by)
    rows = df.withColumn("_own", F.row_number().over(W.partitionBy(*by, is_top).orderBy("rank")))
    rows = rows.withColumn("_kept", F.least(F.lit(least), F.sum(F.col(is_top).cast("int")).over(w)))
    first = F.col(is_top) & (F.col("_own") <= F.col("_kept"))
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(F.when(first, 0).otherwise(1), "rank")))
    return rows.where(F.col("_place") <= total).drop("_own", "_kept", "_place")


def best_per_then_global(df: DataFrame, by: list[str], member: str, total: int) -> DataFrame:
    """The best row of each member first, then the best others by rank, total in all, with their place."""
    rows = df.withColumn("_own", F.row_number().over(W.partitionBy(*by, member).orderBy("rank")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy((F.col("_own") > 1).cast("int"), "rank")).cast("long")).where(F.col("place") <= total).drop("_own")


def skip_budget(df: DataFrame, by: str, key: str, size: str, limit: int, order: str, overhead: int = 0) -> DataFrame:
    """by, key of the rows kept when, in order, each row is taken that still fits: later, smaller rows may follow a skipped one."""
    schema = f"{by} {df.schema[by].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, kept = 0, []
        for row in pdf.sort_values([order, key], kind="stable").itertuples():
            cost = getattr(row, size) + overhead
            if used + cost <= limit:
                used += cost
                kept.append(row.Index)
        return pdf.loc[kept, [by, key]]

    return df.groupBy(by).applyInPandas(run, schema)


def greedy_packages(df: DataFrame, by: str, *, most: int = 12, least: int = 4, page_cap: int = 2, chars: int = 80_000) -> DataFrame:
    """by, package_id, place: packages taken one by one for new modality and paper, then score; df has package_id, paper_id, page, kind, score, size.

    Whole packages under the character budget, at most page_cap per page; stops once `least` are taken and nothing new is left.
    """
    schema = f"{by} {df.schema[by].dataType.simpleString()}, package_id {df.schema['package_id'].dataType.simpleString()}, place long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["score", "package_id"], ascending=[False, True], kind="stable").to_dict("records")
        papers, kinds, pages, used, out = set(), set(), {}, 0, []
        while rows and len(out) < most:
            open_ = [r for r in rows if pages.get((r["paper_id"], r["page"]), 0) < page_cap and used + r["size"] <= chars]
            if not open_:
                break
            best = max(enumerate(open_), key=lambda x: ((x[1]["kind"] not in kinds) + (x[1]["paper_id"] not in papers), x[1]["score"], -x[0]))[1]
            if len(out) >= least and best["kind"] in kinds and best["paper_id"] in papers:
                break
            rows.remove(best)
            papers.add(best["paper_id"])
            kinds.add(best["kind"])
            pages[best["paper_id"], best["page"]] = pages.get((best["paper_id"], best["page"]), 0) + 1
            used += best["size"]
            out.append((best[by], best["package_id"], len(out) + 1))
        return pd.DataFrame(out, columns=[by, "package_id", "place"])

    return df.groupBy(by).applyInPandas(run, schema)
