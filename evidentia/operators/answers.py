"""Answers and predictions repaired, joined and expanded; record bonuses and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from .scoring import rank_by


def paired_recall(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """kind, n, recall of two systems over the same items (item, kind, hit), and how many each alone has."""
    rows = a.select("item", kind, F.col("hit").alias("x")).join(b.select("item", F.col("hit").alias("y")), "item")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.groupBy(kind).agg(F.count("*").alias("n"), share(F.col("x")).alias("recall_a"), share(F.col("y")).alias("recall_b"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"), F.count_if(F.col("y") & ~F.col("x")).alias("only_b"))


def single_value(rows: DataFrame, by: str) -> DataFrame:
    """by, value where the best scored rows (by, value, score) all say the same."""
    best = rows.withColumn("_top", F.max("score").over(W.partitionBy(by))).where("score = _top")
    return best.groupBy(by).agg(F.countDistinct("value").alias("_n"), F.min("value").alias("value")).where("_n = 1").select(by, "value")


def anchor_scores(units: DataFrame, tracks: list[str]) -> DataFrame:
    """record_id and the largest score of each track over the units (record_ids, tracks) that hold it."""
    return units.select(F.explode("record_ids").alias("record_id"), *tracks).groupBy("record_id").agg(*[F.max(t).alias(t) for t in tracks])


def layout_score(modality: Column, target: Column, labelled: Column) -> Column:
    return modality.cast("int") * 1.0 + target.cast("int") * 3.0 + labelled.cast("int") * 0.1


def section_bonus(question: Column, title: Column) -> Column:
    """0.12 for every word of the title in the question, 0.8 at most."""
    both = F.size(F.array_intersect(F.array_distinct(T.tokens(title)), F.array_distinct(T.tokens(question))))
    return F.least(F.lit(0.8), both * 0.12)


def bounded_unit_score(local: Column, section: Column, special: Column) -> Column:
    """A unit's own score, at most a tenth for its section, and for objects a little more."""
    return local + F.least(F.lit(0.1), 0.1 * section) + F.when(special, F.least(F.lit(0.1), 0.15 * section)).otherwise(0.0)


def navigation(records: DataFrame, question_terms: DataFrame, by: str, k: int) -> DataFrame:
    """by, record_id, score, place: records (by, record_id, text) by the summed rarity of the question's terms (by, term) they hold."""
    own = records.select(by, "record_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).join(question_terms, [by, "term"])
    n = records.groupBy(by).agg(F.count("*").alias("n"))
    df = own.groupBy(by, "term").agg(F.count("*").alias("df")).join(n, by)
    rare = df.select(by, "term", F.log(1.0 + F.col("n") / F.col("df")).alias("w"))
    scores = own.join(rare, [by, "term"]).groupBy(by, "record_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return scores.withColumn("place", rank_by([by], F.desc("score"), F.asc("record_id"))).where(F.col("place") <= k)


def profile_rank(papers: DataFrame, profiles: DataFrame, least: float, k: int) -> DataFrame:
    """profile, paper_id, score, place: papers (paper_id, text) by the weights of the profile's terms (profile, term, weight) that they contain as words."""
    words = papers.select("paper_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    scores = words.join(profiles, "term").groupBy("profile", "paper_id").agg(F.round(F.sum("weight"), 6).alias("score")).where(F.col("score") >= least)
    return scores.withColumn("place", rank_by(["profile"], F.desc("score"), F.asc("paper_id"))).where(F.col("place") <= k)


def unclaimed_blocks(blocks: DataFrame, boxes: DataFrame, by: str, pad: float = 0.0, least_chars: int = 20) -> DataFrame:
    """Text blocks (by, block_id, x0, y0, x1, y1, text) of enough characters that touch no used box (by, x0, y0, x1, y1)."""
    b = boxes.select(by, *[F.col(c).alias(f"u_{c}") for c in ("x0", "y0", "x1", "y1")])
    touch = (F.col("x0") - pad < F.col("u_x1")) & (F.col("u_x0") - pad < F.col("x1")) & (F.col("y0") - pad < F.col("u_y1")) & (F.col("u_y0") - pad < F.col("y1"))
    rows = blocks.where(F.length(F.trim("text")) >= least_chars)
    return rows.join(b, (rows[by] == b[by]) & touch, "left_anti")


def expanded(predicted: DataFrame, proven: DataFrame) -> DataFrame:
    """Predicted evidence (query_id, paper_id, key) and what its cited cards prove (same columns), each once, with whether it was predicted."""
    both = predicted.withColumn("own", F.lit(True)).unionByName(proven.withColumn("own", F.lit(False)))
    return both.groupBy("query_id", "paper_id", "key").agg(F.max("own").alias("own"))


def sole_paper_gate(mentions: DataFrame, by: str) -> DataFrame:
    """by, paper_id of questions that name exactly one paper (by, paper_id)."""
    return mentions.groupBy(by).agg(F.countDistinct("paper_id").alias("n"), F.min("paper_id").alias("paper_id")).where("n = 1").select(by, "paper_id")


def capped_visuals(rows: DataFrame, by: str, per_paper: int, most: int) -> DataFrame:
    """by, record_id, place of figure rows (by, paper_id, record_id, content, rank) in rank order: each content once, caps per paper and in all."""
    first = rows.withColumn("_c", rank_by([by, "content"], F.asc("rank"), F.asc("record_id"))).where("_c = 1")
    own = first.withColumn("_p", rank_by([by, "paper_id"], F.asc("rank"), F.asc("record_id"))).where(F.col("_p") <= per_paper)
    return own.withColumn("place", rank_by([by], F.asc("rank"), F.asc("record_id"))).where(F.col("place") <= most).select(by, "record_id", "place")


def flattened(json_text: Column) -> Column:
    """Top-level and nested scalars of a JSON object as `path=value` strings, two levels deep, sorted."""
    top = F.from_json(json_text, "map<string,string>")
    pairs = F.map_entries(F.coalesce(top, F.create_map().cast("map<string,string>")))
    nested = lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.concat(e["key"], F.lit("."), x["key"], F.lit("="), F.coalesce(x["value"], F.lit("null"))))
    one = lambda e: F.when(F.coalesce(e["value"], F.lit("")).startswith("{"), F.coalesce(nested(e), F.array().cast("array<string>"))).otherwise(F.array(F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))))
    return F.array_sort(F.flatten(F.transform(pairs, one)))
