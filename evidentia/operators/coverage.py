"""Which gold items members of a group cover: sets of any number of items, without dominated ones; exact and greedy cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import dealt_by_size, staged

#: Sets whose items meet in one task.
PART = 200_000


def coverage_sets(hits: DataFrame, by: str, member: str, item: str) -> DataFrame:
    """by, member, items: the different gold items that each member covers, sorted. Null items count for nothing; a member without items has an empty set."""
    return hits.groupBy(by, member).agg(F.array_sort(F.collect_set(item)).alias("items"))


def undominated(sets: DataFrame, by: str, member: str) -> DataFrame:
    """by, items, member: one member per set (the smallest), without empty sets and sets that a larger one contains.

    A set meets only the larger ones that hold its rarest item, so members without a common item never meet.
    """
    return _undominated(_different(sets, by, member), by, member)


def _different(sets: DataFrame, by: str, member: str) -> DataFrame:
    """by, items, member: one member per set, empty ones too. Written once."""
    return staged(sets.groupBy(by, "items").agg(F.min(member).alias(member)), "sets", PART)


def _undominated(different: DataFrame, by: str, member: str) -> DataFrame:
    own = different.where(F.size("items") > 0)
    held = own.select(by, member, F.size("items").alias("_size"), F.explode("items").alias("_item"))
    of = W.partitionBy(by, "_item")
    told = dealt_by_size(held, different.count(), PART, by).withColumn("_n", F.count("*").over(of)).withColumn("_top", F.max("_size").over(of))
    rare = told.groupBy(by, member).agg(F.min(F.struct("_n", "_item", "_top", "_size")).alias("_r")).select(by, member, "_r.*").where("_top > _size")  # others are in no larger set
    same = lambda a, b: (F.col(f"{a}.{by}") == F.col(f"{b}.{by}")) & F.col(f"{a}.{member}").eqNullSafe(F.col(f"{b}.{member}"))
    rare = rare.alias("r").join(own.alias("o"), same("r", "o")).select(f"o.{by}", f"o.{member}", "_item", "items")
    more = own.where(F.size("items") > 1).select(by, F.explode("items").alias("_item"), F.col("items").alias("_more"))
    lost = rare.join(more, [by, "_item"]).where((F.size("_more") > F.size("items")) & (F.size(F.array_except("items", "_more")) == 0))
    return own.alias("o").join(lost.select(by, member).distinct().alias("l"), same("o", "l"), "left_anti")


def _best_cover(sets: list[int], budget: int) -> tuple[int, list[int]]:
    """The most bits that `budget` of the sets hold together, and the numbers of such sets: depth first, with bounds.

    What a choice can still add is at most the sum of the largest gains that are left, and at most what all sets that
    are left hold beyond what is covered; branches that can't beat the best so far end there.
    """
    best, chosen = 0, []
    open_ = [(0, [], list(range(len(sets))), budget)]
    while open_:
        seen, taken, left, more = open_.pop()
        if seen.bit_count() > best:
            best, chosen = seen.bit_count(), taken
        gains = sorted(((sets[k] & ~seen).bit_count(), -k) for k in left)[::-1]
        gains = [(g, -k) for g, k in gains if g]
        if not more or not gains:
            continue
        if seen.bit_count() + sum(g for g, _ in gains[:more]) <= best:
            continue
        rest = seen
        for _, k in gains:
            rest |= sets[k]
        if rest.bit_count() <= best:
            continue
        (_, first), others = gains[0], [k for _, k in gains[1:]]
        open_.append((seen, taken, others, more))
        open_.append((seen | sets[first], [*taken, first], others, more - 1))  # looked at first
    return best, chosen


def _bits(frame: pd.DataFrame) -> list[int]:
    place = {x: k for k, x in enumerate(sorted({x for items in frame["items"] for x in items}))}
    return [sum(1 << place[x] for x in items) for items in frame["items"]]


def max_coverage(sets: DataFrame, by: str, member: str, budget: int) -> DataFrame:
    """by, covered, members: the most gold items that `budget` members can cover, exactly, and members that do it. sets: by, member, items.

    Groups whose sets are all empty cover nothing. Only undominated sets meet in one task, a question's own.
    """
    key, kind = sets.schema[by].dataType.simpleString(), sets.schema[member].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(member, kind="stable")
        covered, chosen = _best_cover(_bits(pdf), max(0, budget))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "covered": [covered], "members": [sorted(pdf[member].iloc[k] for k in chosen)]})

    different = _different(sets, by, member)
    best = _undominated(different, by, member).groupBy(by).applyInPandas(run, f"{by} {key}, covered long, members array<{kind}>")
    return different.select(by).distinct().join(best, by, "left").select(by, F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("members", F.array().cast(f"array<{kind}>")).alias("members"))


def greedy_coverage(sets: DataFrame, by: str, member: str, budget: int, page_cap: int, score: str | None = None) -> DataFrame:
    """by, covered: gold items covered by members taken one by one for the most new items, then the larger set, the better score (none: -1), the smaller member.

    At most page_cap members of a page; ends when none adds anything. sets: by, member, page, items and the score.
    """
    info = sets.select(by, member, "page", (F.coalesce(F.col(score).cast("double"), F.lit(-1.0)) if score else F.lit(-1.0)).alias("_score"))
    rows = undominated(sets, by, member).join(info, [by, member])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(member, kind="stable")
        bits, pages, scores = _bits(pdf), [None if pd.isna(p) else p for p in pdf["page"]], pdf["_score"].tolist()
        seen, full, left = 0, {}, set(range(len(bits)))
        for _ in range(budget):
            open_ = [k for k in left if full.get(pages[k], 0) < max(1, page_cap)]
            best = max(open_, key=lambda k: ((bits[k] & ~seen).bit_count(), bits[k].bit_count(), scores[k], -k), default=None)
            if best is None or not bits[best] & ~seen:
                break
            left.remove(best)
            full[pages[best]] = full.get(pages[best], 0) + 1
            seen |= bits[best]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "covered": [seen.bit_count()]})

    best = rows.groupBy(by).applyInPandas(run, f"{by} {sets.schema[by].dataType.simpleString()}, covered long")
    return sets.select(by).distinct().join(best, by, "left").select(by, F.coalesce("covered", F.lit(0)).alias("covered"))
