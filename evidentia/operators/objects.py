"""Equations, algorithms, figures and tables of a page, from its text blocks and visual boxes. Crops are a renderer's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import text_of
from .scoring import rank_by

# How objects are labelled, and what mathematics looks like.
ALGORITHM = r"(?i)^\s*Algorithm\s*([A-Za-z]?\d+[A-Za-z0-9.\-]*)\b"
EQUATION_NUMBER = r"\(\s*([A-Za-z]?\d+[A-Za-z0-9.\-]*)\s*\)\s*$"
MATH = r"(?:=|≤|≥|≈|∑|∏|∇|∂|∫|\barg\b|\bmin\b|\bmax\b|\blog\b|\bexp\b|\\[a-zA-Z]+|[α-ωΑ-Ω])"
MATH_MARK = r"(?:=|≤|≥|≈|∑|∏|∇|∂|∫|\\[a-zA-Z]+|[α-ωΑ-Ω]|\^|_|[{}])"
PSEUDOCODE = r"(?i)\b(?:Input|Output|Require|Ensure|for|while|if|return|repeat)\b"
FIGURE_CAPTION = r"(?i)^(?:Figure|Fig\.)\s*([A-Za-z]?\d+[A-Za-z0-9\-]*)[A-Za-z0-9.\-]*\s*[:.]"
TABLE_CAPTION = r"(?i)^(?:Table|Tab\.)\s*([A-Za-z]?\d+[A-Za-z0-9\-]*)"
MENTION = r"(?i)\b(?:Figure|Fig\.)\s*([A-Za-z]?\d+[A-Za-z0-9]*)"
BOX = ("x0", "y0", "x1", "y1")


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(text), r"\s+", " "))


def _labelled(word: str, text: Column, pattern: str) -> Column:
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[.,;:]+$", "")
    return F.when(number != "", F.concat(F.lit(f"{word} "), number))


def algorithm_label(text: Column) -> Column:
    """`Algorithm n` of a block that begins so and reads like pseudocode or is short; null otherwise."""
    flat = _flat(text)
    return F.when(flat.rlike(PSEUDOCODE) | (F.length(flat) < 500), _labelled("Algorithm", flat, ALGORITHM))


def equation_label(text: Column) -> Column:
    """`Equation n` of a text with mathematics and a number in brackets at its end; null otherwise."""
    flat = _flat(text)
    return F.when(flat.rlike(MATH), _labelled("Equation", flat, EQUATION_NUMBER))


def math_heavy(line: Column) -> Column:
    """Whether a line is mathematics: 8 to 420 characters, two marks, or one among at most eight words."""
    flat = _flat(line)
    marks, prose = (F.size(F.regexp_extract_all(flat, F.lit(p), 0)) for p in (MATH_MARK, r"\b[a-zA-Z]{4,}\b"))
    return F.length(flat).between(8, 420) & flat.rlike(MATH) & ((marks >= 2) | ((marks >= 1) & (prose <= 8)))


def equations(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """paper_id, page, kind, label, at, rule: algorithms and equations of pages, each label once.

    blocks and lines: paper_id, page, at, text. Blocks come first; of lines, those that are mathematics add labels that no block
    has, and one without a number stands for `Equation 0`.
    """
    # texts are labelled once, before any row is dropped; one sort then says which labels of lines no block has
    every = F.struct(algorithm_label(F.col("_flat")).alias("a"), equation_label(F.col("_flat")).alias("e"))
    b = blocks.select("paper_id", "page", "at", _flat(F.col("text")).alias("_flat")).select("paper_id", "page", "at", F.explode_outer(F.array(every)).alias("_l")).select("paper_id", "page", "at", "_l.*")
    b = b.withColumn("label", F.coalesce("a", "e")).where("label is not null").select("paper_id", "page", F.when(F.col("a").isNotNull(), "algorithm").otherwise("equation").alias("kind"), "label", "at", F.lit("block").alias("rule"))
    named = F.when(math_heavy(F.col("_flat")), F.coalesce(equation_label(F.col("_flat")), F.lit("Equation 0")))
    n = lines.select("paper_id", "page", "at", _flat(F.col("text")).alias("_flat")).select("paper_id", "page", "at", F.explode_outer(F.array(named)).alias("label")).where("label is not null")
    n = n.select("paper_id", "page", F.lit("equation").alias("kind"), "label", "at", F.lit("line_level_math_fallback").alias("rule"))
    # a page's blocks may repeat a label; its lines may not
    both = b.withColumn("_line", F.lit(0)).unionByName(n.withColumn("_line", F.lit(1)))
    both = both.withColumn("_i", rank_by(["paper_id", "page", "label"], F.asc("_line"), F.asc("at")))
    return both.where("_line = 0 or _i = 1").select(b.columns)


def figures(blocks: DataFrame, visuals: DataFrame, *, page_height: float = 842.0) -> DataFrame:
    """paper_id, page, label, at, x0, y0, x1, y1, parts, rule: figures of pages, each label once, with the box of their body.

    blocks: paper_id, page, at, text and a box; visuals: paper_id, page, visual_id and a box. A caption's anchor is the visual
    whose centre is nearest, sideways counting 0.18, within 45 % of the page's height; specks under 400 are none. The body is
    the anchor with what is within 18 % of the height or 45 points of it. A figure that is only mentioned has no box.
    """
    label = _labelled("Figure", _flat(F.col("text")), FIGURE_CAPTION)
    c = blocks.withColumn("label", label).where("label is not null").withColumn("_i", rank_by(["paper_id", "page", "label"], F.asc("at"))).where("_i = 1")
    c = c.select("paper_id", "page", "label", "at", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    v = visuals.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 400).withColumn("bx", (F.col("x0") + F.col("x1")) / 2).withColumn("by", (F.col("y0") + F.col("y1")) / 2)
    near = c.join(v, ["paper_id", "page"]).where(F.abs(F.col("by") - F.col("cy")) <= 0.45 * page_height)
    key = ["paper_id", "page", "label"]
    near = near.withColumn("_v", rank_by(key, F.asc(F.abs(F.col("by") - F.col("cy")) + 0.18 * F.abs(F.col("bx") - F.col("cx"))), F.asc("visual_id")))
    first = near.where("_v = 1").select(*key, F.col("by").alias("ay"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
    gap = F.greatest(F.lit(0.0), F.greatest("a0", "y0") - F.least("a1", "y1"))
    body = near.join(first, key).where((F.abs(F.col("by") - F.col("ay")) <= 0.18 * page_height) | (gap <= 45))
    body = body.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("parts"))
    own = c.select(*key, "at").join(body, key, "left").withColumn("parts", F.coalesce("parts", F.lit(0))).withColumn("rule", F.lit("caption_nearest_visual"))
    said = blocks.select("paper_id", "page", "at", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(_flat(F.col("text")), F.lit(MENTION), 1), lambda m: F.concat(F.lit("Figure "), m)))).alias("label"))
    said = said.join(own.select(*key), key, "left_anti").withColumn("_i", rank_by(key, F.asc("at"))).where("_i = 1")
    none = [F.lit(None).cast(visuals.schema[x].dataType).alias(x) for x in BOX]
    return own.select(*key, "at", *BOX, "parts", "rule").unionByName(said.select(*key, "at", *none, F.lit(0).cast("long").alias("parts"), F.lit("figure_mention_fallback").alias("rule")))


#: How far a caption's edge may be from a table's, and what a point sideways counts.
CAPTION_GAP, SIDEWAYS = 90.0, 0.08


def near_captions(regions: DataFrame, captions: DataFrame, *, far: float = CAPTION_GAP) -> DataFrame:
    """paper_id, page, region_id, caption_at, label, gap, sideways of every region and caption within `far`: the least distance between the caption's lower and the region's upper edge, or the other way round.

    Edges meet in bins of `far` points, so pairs that are farther apart than two bins are never made. captions: paper_id, page, caption_at, label and a box.
    """
    edge = lambda side, y: F.struct(F.lit(side).alias("side"), y.cast("double").alias("y"))
    centre = ((F.col("x0") + F.col("x1")) / 2).alias
    own = regions.select("paper_id", "page", "region_id", centre("_rx"), F.explode(F.array(edge("above", F.col("y0")), edge("below", F.col("y1")))).alias("_e"))
    own = own.select("paper_id", "page", "region_id", "_rx", "_e.side", F.col("_e.y").alias("_ry"), F.explode(F.sequence(F.floor(F.col("_e.y") / far) - 1, F.floor(F.col("_e.y") / far) + 1)).alias("bin"))
    other = captions.select("paper_id", "page", "caption_at", "label", centre("_cx"), F.explode(F.array(edge("above", F.col("y1")), edge("below", F.col("y0")))).alias("_e"))
    other = other.select("paper_id", "page", "caption_at", "label", "_cx", "_e.side", F.col("_e.y").alias("_cy"), F.floor(F.col("_e.y") / far).alias("bin"))
    met = own.join(other, ["paper_id", "page", "side", "bin"]).withColumn("gap", F.abs(F.col("_ry") - F.col("_cy"))).where(F.col("gap") <= far)
    return met.groupBy("paper_id", "page", "region_id", "caption_at", "label").agg(F.min("gap").alias("gap"), F.min(F.abs(F.col("_rx") - F.col("_cx"))).alias("sideways"))


def tables(blocks: DataFrame, regions: DataFrame, *, far: float = CAPTION_GAP) -> DataFrame:
    """paper_id, page, region_id, label, caption_at, kind: tables of pages.

    blocks: as for figures; regions: paper_id, page, region_id, kind (grid or aligned), rows (how many) and a box. A grid needs two rows
    and 20 points of height, aligned lines three rows. A region takes the caption of least distance among near_captions(), where
    sideways points count SIDEWAYS, none otherwise; of regions with one label the first counts, grids before aligned lines, then from the top.
    """
    c = blocks.withColumn("label", _labelled("Table", _flat(F.col("text")), TABLE_CAPTION)).where("label is not null").withColumnRenamed("at", "caption_at")
    enough = F.when(F.col("kind") == "grid", (F.col("rows") >= 2) & (F.col("y1") - F.col("y0") >= 20)).otherwise(F.col("rows") >= 3)
    r = regions.where(enough)
    near = near_captions(r, c, far=far)
    near = near.withColumn("_i", rank_by(["paper_id", "page", "region_id"], F.asc(F.col("gap") + SIDEWAYS * F.col("sideways")), F.asc("caption_at"))).where("_i = 1").select("paper_id", "page", "region_id", "label", "caption_at")
    rows = r.join(near, ["paper_id", "page", "region_id"], "left")
    rows = rows.withColumn("_i", rank_by(["paper_id", "page", "label"], F.asc((F.col("kind") != "grid").cast("int")), F.asc("y0"), F.asc("region_id"))).where(F.col("label").isNull() | (F.col("_i") == 1))
    return rows.select("paper_id", "page", "region_id", "label", "caption_at", "kind")
