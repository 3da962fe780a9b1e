"""Score normalisation, pooling and fusion as window and aggregate expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import staged

#: Vectors and asked vectors that meet in one task, asked ones multiplied at once, and how far products may be from sums made in order.
BLOCK, SLICE, AT_ONCE, MARGIN = 8192, 4096, 256, 2e-6


def min_max(value: str, by: list[str], constant: float = 0.5) -> Column:
    """value scaled to 0..1 within `by`; nulls stay null, equal values become `constant`."""
    w = W.partitionBy(*by)
    low, high, v = F.min(value).over(w), F.max(value).over(w), F.col(value)
    return F.when(v.isNull(), None).when(high <= low, F.lit(constant)).otherwise((v - low) / (high - low))


def pooled(scores: DataFrame, by: list[str], value: str, *, sharpness: float, k: int) -> DataFrame:
    """Per group: mean, maximum, mean of the k best, and log-mean-exp about the maximum (so it never overflows)."""
    w = W.partitionBy(*by)
    rows = scores.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(value)))).withColumn("_top", F.max(value).over(w))
    shifted = F.log(F.avg(F.exp((F.col(value) - F.col("_top")) * sharpness))) / sharpness
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("maximum"), F.avg(F.when(F.col("_rn") <= k, F.col(value))).alias("top_mean"), (F.max("_top") + shifted).alias("lme"))


def rank_by(by: list[str], *order: Column) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")


def reciprocal_rank(*ranks: str, k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over the routes that have a rank."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.lit(1.0) / (k + F.col(r)), F.lit(0.0))
    return out


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest_ranks(df: DataFrame, by: str, value: str, fractions: dict[str, float], *, buckets: int = 4096) -> DataFrame:
    """by and a column per fraction: nearest-rank percentiles, the value at position ceil(fraction * n), one at least.

    Values are counted in equal ranges first, and only the range in which a position lies is sorted, its equal values as one; so a
    group of any size is in no task as a whole. Null values don't count; a group without others is left out.
    """
    rows = df.select(by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    stats = rows.groupBy(by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets))).cast("int")
    dealt = rows.join(stats, by).withColumn("_b", place)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(f) - 1e-9)).alias("pos")) for name, f in fractions.items()]))
    counts = dealt.groupBy(by, "_b").agg(F.count("*").alias("c"))
    counts = counts.withColumn("before", F.sum("c").over(W.partitionBy(by).orderBy("_b")) - F.col("c"))
    goal = stats.select(by, wanted.alias("w")).select(by, "w.name", "w.pos").join(counts, by).where((F.col("before") < F.col("pos")) & (F.col("pos") <= F.col("before") + F.col("c"))).select(by, "name", "_b", (F.col("pos") - F.col("before")).alias("rest"))
    near = dealt.select(by, "_b", "_v").join(goal, [by, "_b"]).groupBy(by, "name", "rest", "_v").agg(F.count("*").alias("c"))
    near = near.withColumn("upto", F.sum("c").over(W.partitionBy(by, "name").orderBy("_v"))).where(F.col("upto") >= F.col("rest"))
    best = near.groupBy(by, "name").agg(F.min("_v").alias("v"))
    return best.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions])


def precision_recall(g: Column, p: Column, c: Column) -> list[Column]:
    """precision, recall and f1 of numbers of items: gold, predicted and common ones."""
    precision = F.when((g == 0) & (p == 0), 1.0).when(p == 0, 0.0).otherwise(c / p)
    recall = F.when(g == 0, 1.0).otherwise(c / g)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def coverage(gold: DataFrame, pred: DataFrame, by: str, item: str) -> DataFrame:
    """Precision, recall and F1 of two sets of items per key of gold: both empty 1, 1, 1; nothing predicted 0, 0, 0."""
    g = gold.select(by, item).where(F.col(item).isNotNull()).distinct()
    p = pred.select(by, item).where(F.col(item).isNotNull()).distinct()
    sizes = gold.select(by).distinct().join(g.groupBy(by).agg(F.count("*").alias("g")), by, "left").join(p.groupBy(by).agg(F.count("*").alias("p")), by, "left").join(g.join(p, [by, item]).groupBy(by).agg(F.count("*").alias("c")), by, "left").na.fill(0)
    return sizes.select(by, *precision_recall(F.col("g"), F.col("p"), F.col("c")))


def _nearest_in_block(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest held vectors of each asked one, by cosines rounded to six places as Spark rounds them, then by the smaller id.

    Products of matrices name candidates; those are summed again in the order of Spark's aggregate, so no rounding differs.
    """
    out = {"query_id": [], "vec_id": []}
    if len(asked) and len(held):
        held = held.sort_values("vec_id")
        ids, v = held["vec_id"].to_numpy(), np.stack(held["embedding"].to_numpy()).astype("float64")
        summed = lambda a, b: sum((a[..., d] * b[..., d] for d in range(1, v.shape[1])), 0.0 + a[..., 0] * b[..., 0])
        squares = summed(v, v)
        for start in range(0, len(asked), AT_ONCE):
            part = asked.iloc[start : start + AT_ONCE]
            names, q = part["query_id"].to_numpy(), np.stack(part["q"].to_numpy()).astype("float64")
            own = summed(q, q)
            rough = (q @ v.T) / np.sqrt(own[:, None] * squares[None, :])
            rough[names[:, None] == ids[None, :]] = -np.inf
            least = np.partition(rough, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))] - MARGIN
            for i, name in enumerate(names):
                near = np.flatnonzero((rough[i] >= least[i]) & (ids != name))
                exact = summed(v[near], q[i]) / np.sqrt(own[i] * squares[near])
                values, place = np.unique(exact, return_inverse=True)
                rounded = np.array([float(Decimal(repr(float(x))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for x in values])[place] if len(near) else exact
                best = near[np.lexsort((ids[near], -rounded))[:k]]
                out["query_id"] += [name] * len(best)
                out["vec_id"] += ids[best].tolist()
    return pd.DataFrame(out).astype("int64")


def nearest_pairs(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id: pairs of asked (query_id, q) and held (vec_id, embedding) vectors that hold each one's k nearest by cosine, few others.

    All pairs are compared, as products of blocks: blocks of held vectors meet slices of asked ones, and k of a block leave its task. Vectors that are
    null, zero, of another length than most or hold null or non-finite components meet all others, as they have no product.
    """
    sound = lambda c: F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e15)) & F.exists(c, lambda x: F.abs(x) > 1e-30), F.lit(False))
    a = asked.withColumn("_ok", sound("q")).withColumn("_n", F.size("q"))
    h = held.withColumn("_ok", sound("embedding")).withColumn("_n", F.size("embedding"))
    sizes = h.where("_ok").groupBy("_n").count().orderBy(F.desc("count"), "_n").first()
    length = sizes["_n"] if sizes else 0
    n, m = sizes["count"] if sizes else 0, a.count()
    blocks, slices = n // BLOCK + 1, m // SLICE + 1
    fits = F.col("_ok") & (F.col("_n") == length)
    deal = lambda df, key, own, of, other, others: df.where(fits).select("*", F.pmod(F.xxhash64(key), F.lit(of)).alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<bigint>"))).drop("_ok", "_n")
    left, right = deal(a, "query_id", "_s", slices, "_b", blocks), deal(h, "vec_id", "_b", blocks, "_s", slices)
    met = left.groupBy("_b", "_s").cogroup(right.groupBy("_b", "_s")).applyInPandas(lambda x, y: _nearest_in_block(x, y, k), "query_id long, vec_id long")
    odd = a.where(~fits).select("query_id").join(held.select("vec_id"), F.col("query_id") != F.col("vec_id"))
    odd = odd.unionByName(a.where(fits).select("query_id").join(h.where(~fits).select("vec_id"), F.col("query_id") != F.col("vec_id")))
    return staged(met.unionByName(odd), "nearest")
