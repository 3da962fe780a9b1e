"""Ordered records: sections, neighbours, runs, references, units."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scoring import rank_by


def sections(records: DataFrame, by: str, order: str, is_heading: Column, title: Column) -> DataFrame:
    """records with section_no and section_title: the latest heading, itself included; before any, section 0 and `front matter`."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = records.withColumn("section_no", F.sum(is_heading.cast("long")).over(w))
    return rows.withColumn("section_title", F.coalesce(F.last(F.when(is_heading, title), ignorenulls=True).over(w), F.lit("front matter")))


def neighbours(records: DataFrame, by: str, order: str, key: str, reach: int) -> DataFrame:
    """records with `around`: the keys of rows at most `reach` places before or behind, in order, without the row's own."""
    w = W.partitionBy(by).orderBy(order)
    span = lambda a, b: F.collect_list(key).over(w.rowsBetween(a, b))
    return records.withColumn("around", F.concat(span(-reach, -1), span(1, reach)))


def nearest(anchors: DataFrame, records: DataFrame, by: str, order: str, key: str, k: int) -> DataFrame:
    """by, anchor, key, place: the k records of the same `by` nearest to each anchor by order, itself excluded."""
    a = anchors.select(by, F.col(key).alias("anchor"), F.col(order).alias("_at"))
    pairs = a.join(records.select(by, key, order), by).where(F.col("anchor") != F.col(key)).withColumn("distance", F.abs(F.col(order) - F.col("_at")))
    return pairs.withColumn("place", rank_by([by, "anchor"], F.asc("distance"), F.asc(order), F.asc(key))).where(F.col("place") <= k).select(by, "anchor", key, "place")


def runs(rows: DataFrame, by: str, order: str, hit: Column, least: int) -> DataFrame:
    """by, first, last, n of runs of at least `least` neighbouring rows with hit."""
    w = W.partitionBy(by).orderBy(order)
    marked = rows.withColumn("_hit", hit).withColumn("_rn", F.row_number().over(w)).where("_hit").withColumn("_island", F.col("_rn") - F.row_number().over(w))
    return marked.groupBy(by, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_island")


def references(records: DataFrame, by: str, order: str) -> DataFrame:
    """by, number, text of bibliography entries of records (by, order, kind, text), kind being `heading` or `paragraph`.

    Entries start behind a References or Bibliography heading and end at any other. Paragraphs of under 20 characters
    are passed over. A printed `[n]`, `n.` or `n)` is the number, else the last number plus one; a paragraph that
    starts in lower case or with a mark goes on with the entry before it.
    """
    w = W.partitionBy(by).orderBy(order)
    heading = F.col("kind") == "heading"
    active = F.coalesce(F.last(F.when(heading, F.lower(F.trim("text")).rlike("^(?:references|bibliography)$")), ignorenulls=True).over(w), F.lit(False))
    rows = records.withColumn("_on", active).where(F.col("_on") & ~heading & (F.length("text") >= 20))
    printed = F.coalesce(F.nullif(F.regexp_extract("text", r"^\s*\[(\d{1,4})\]", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"^\s*(\d{1,4})[.)]\s", 1), F.lit(""))).cast("long")
    more = F.col("text").rlike(r"^\s*[a-z,;:)\]]") & (F.row_number().over(w) > 1)
    rows = rows.withColumn("_printed", printed).withColumn("_more", more & printed.isNull())
    rows = rows.withColumn("_entry", F.sum((~F.col("_more")).cast("long")).over(w))
    entry = rows.groupBy(by, "_entry").agg(F.max("_printed").alias("_printed"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))
    # without a printed number: the last printed one and how many entries have passed since
    we = W.partitionBy(by).orderBy("_entry").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("_printed").isNotNull(), F.struct("_entry", "_printed")), ignorenulls=True).over(we)
    number = F.coalesce(last["_printed"] + F.col("_entry") - last["_entry"], F.col("_entry"))
    return entry.select(by, number.alias("number"), "text")


def pack_units(records: DataFrame, by: str, order: str, *, target: int = 1280, most: int = 1536, overlap: int = 1) -> DataFrame:
    """by, unit, ids, n_tokens: records (by, order, record_id, text) packed into units by white-space tokens.

    A unit is flushed when the next record would pass `most`, or once `target` is reached; the last `overlap` records
    begin the next unit. A record longer than `most` is cut into pieces of its own.
    """
    schema = f"{by} {records.schema[by].dataType.simpleString()}, unit long, ids array<{records.schema['record_id'].dataType.simpleString()}>, n_tokens long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], []

        def flush() -> None:
            nonlocal held
            if held:
                out.append(([i for i, _ in held], sum(n for _, n in held)))
                held = held[-overlap:] if overlap else []

        for row in pdf.sort_values(order, kind="stable").itertuples():
            n = len((row.text or "").split())
            if held and sum(x for _, x in held) + n > most:
                flush()
            if n > most:
                out.extend(([row.record_id], min(most, n - at)) for at in range(0, n, most))
                held = []
                continue
            held.append((row.record_id, n))
            if sum(x for _, x in held) >= target:
                flush()
        flush()
        own = pdf[by].iloc[0]
        return pd.DataFrame({by: own, "unit": range(1, len(out) + 1), "ids": [i for i, _ in out], "n_tokens": [n for _, n in out]})

    return records.groupBy(by).applyInPandas(run, schema)
