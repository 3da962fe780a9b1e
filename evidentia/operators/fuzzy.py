"""Fuzzy title joins: rare tokens and letter runs block, sequences decide, near ties are refused."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..functions.json_tools import normalized_title, sequence_ratio


GRAM = 3


@pandas_udf(ArrayType(StringType()))
def _grams(names: pd.Series) -> pd.Series:
    """Runs of three letters of a title, each with how many equal ones stand before it, so that none is there twice."""

    def numbered(name: str) -> list[str]:
        seen: Counter = Counter()
        out = []
        for g in (name[i : i + GRAM] for i in range(len(name) - GRAM + 1)):
            out.append(f"{g}#{seen[g]}")
            seen[g] += 1
        return out

    return names.map(lambda name: numbered(name or ""))


def _prefixes(rows: DataFrame, counts: DataFrame, key: str, column: str, keep: Column) -> DataFrame:
    """rows once for each of their `keep` rarest elements of an array (as w); those that counts (w, n) lacks come first."""
    each = rows.select(key, "id", F.explode(column).alias("w"), keep.alias("keep")).join(counts, "w", "left")
    order = W.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "w")
    return each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("keep")).select("id", "w")


def title_join(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, title: str = "title", least: float = 0.92, gap: float = 0.03) -> DataFrame:
    """left_key, right_key, score of unambiguous title matches.

    The score is the sequence ratio, or .65 containment + .35 Jaccard where five tokens are shared, containment is .85
    and Jaccard .55 at least. A best match less than `gap` before the second is none.

    No pair with a score is lost, however frequent its words: such pairs share one of their rarest tokens, as many as
    five or 55 % of shared tokens leave over, or one of their rarest letter runs, as many as the edits that `least`
    allows can touch; below 0.9, where they may share none, all pairs meet.
    """
    own = lambda df, key, name: df.select(F.col(key), normalized_title(F.col(title)).alias(name)).withColumn(f"{name}_t", F.array_distinct(F.split(name, " "))).where(F.size(f"{name}_t") >= 4).withColumn(f"{name}_g", _grams(name)).dropDuplicates([key, name]).withColumn("id", F.struct(key, name))
    a, b = own(left, left_key, "x"), own(right, right_key, "y")
    edits = lambda n: F.floor((1 - least) * n + 1e-9)
    pairs = None
    for kind in ("t", "g"):
        counts = b.select(F.explode(f"y_{kind}").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        n = lambda name: F.size(f"{name}_t")
        # at least five tokens and 55 % of either title are shared; a title's partner is at most (2 - least) / least as long
        tokens = lambda name: F.when(n(name) >= 5, n(name) - F.greatest(F.lit(5), F.ceil(0.55 * n(name) - 1e-9)) + 1).otherwise(0)
        letters = lambda name: GRAM * edits(F.length(name) * 2 / least) + 1
        keep = tokens if kind == "t" else letters
        sides = [_prefixes(df, counts, key, f"{name}_{kind}", keep(name)).withColumnRenamed("id", side) for df, key, name, side in ((a, left_key, "x", "_l"), (b, right_key, "y", "_r"))]
        both = (sides[0].join(sides[1], "w") if kind == "t" or least >= 0.9 else a.select(F.col("id").alias("_l")).crossJoin(b.select(F.col("id").alias("_r")))).select("_l", "_r")
        if kind == "g":
            total = F.length("_l.x") + F.length("_r.y")
            both = both.where(2 * F.least(F.length("_l.x"), F.length("_r.y")) >= least * total - 1e-9)
        pairs = both if pairs is None else pairs.unionByName(both)
    pairs = pairs.distinct().join(a.withColumnRenamed("id", "_l"), "_l").join(b.withColumnRenamed("id", "_r"), "_r").drop("_l", "_r").dropDuplicates([left_key, right_key])
    near = F.size(F.array_intersect("x_g", "y_g")) >= F.greatest(F.size("x_g"), F.size("y_g")) - GRAM * edits(F.length("x") + F.length("y"))
    both = F.size(F.array_intersect("x_t", "y_t")).cast("double")
    contained, jaccard = both / F.least(F.size("x_t"), F.size("y_t")), both / F.size(F.array_union("x_t", "y_t"))
    mixed = F.when((both >= 5) & (contained >= 0.85) & (jaccard >= 0.55), 0.65 * contained + 0.35 * jaccard).otherwise(0.0)
    scored = pairs.withColumn("ratio", sequence_ratio(F.when(near, F.col("x")), "y")).withColumn("score", F.greatest(F.when(F.col("ratio") >= least, F.col("ratio")).otherwise(0.0), mixed)).where("score > 0")
    w = W.partitionBy(left_key).orderBy(F.desc("score"), right_key)
    ranked = scored.withColumn("rn", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.where((F.col("rn") == 1) & (F.col("score") - F.col("next") >= gap)).select(left_key, right_key, F.round("score", 6).alias("score"))
