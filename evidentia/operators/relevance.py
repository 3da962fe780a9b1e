"""Relevance of units and sections with the back end as a column: lexical, dense, both or a reranker with its fallbacks, in one plan for all questions.

units: query_id, unit_id, paper_id, section_id, section_at and unit_at (their order), kind (`text`, or `object_<type>`), section_title, section_type, and
raw scores lexical, dense, reranked (null: not scored). questions: query_id, question, backend, fallback, primary (an evidence type).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import text_of
from .scoring import rank_by

# Names of back ends and fallbacks.
BACKENDS = ("bm25", "e5_base_v2", "hybrid", "llmrerank")
FALLBACKS = ("none", "bm25", "e5_base_v2", "hybrid")

# What questions call sections, kinds of sections that titles tell, and where evidence of a type is likely.
SECTION_NAMES = {
    "abstract": "abstract",
    "introduction": "introduction",
    "related work": "related_work",
    "background": "background",
    "method": "methods",
    "methods": "methods",
    "methodology": "methods",
    "experimental setup": "experiments",
    "experiments": "experiments",
    "results": "results",
    "discussion": "discussion",
    "conclusion": "conclusion",
    "limitations": "limitations",
    "references": "references",
    "appendix": "appendix",
}
TITLE_TERMS = (
    ("literature review", "literature_review"),
    ("implementation detail", "implementation_details"),
    ("related work", "related_work"),
    ("preliminar", "preliminaries"),
    ("architecture", "architecture"),
    ("framework", "framework"),
    ("overview", "overview"),
    ("evaluation", "evaluation"),
    ("ablation", "ablation"),
    ("analysis", "analysis"),
    ("dataset", "dataset"),
    ("objective", "objective"),
    ("optimization", "optimization"),
    ("background", "background"),
    ("approach", "approach"),
    ("model", "model"),
)
PRIORS = {
    "citation_context": {"introduction": 1.0, "related_work": 1.0, "background": 0.8, "literature_review": 1.0, "discussion": 0.5, "experiments": 0.3, "method": 0.2, "references": 0.6, "appendix": 0.2},
    "table": {"experiments": 1.0, "results": 1.0, "evaluation": 1.0, "ablation": 1.0, "analysis": 0.8, "dataset": 0.6, "implementation_details": 0.6, "method": 0.4, "appendix": 0.6},
    "figure": {"method": 1.0, "architecture": 1.0, "framework": 1.0, "overview": 0.8, "experiments": 0.7, "results": 0.7, "analysis": 0.7, "appendix": 0.5},
    "equation_algorithm": {"method": 1.0, "approach": 1.0, "model": 1.0, "objective": 1.0, "optimization": 1.0, "preliminaries": 0.7, "background": 0.5, "implementation_details": 0.5, "appendix": 0.7},
}
REFERENCE_INTENT = r"\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last|\d+(?:st|nd|rd|th)|how many)\s+(?:\w+\s+){0,3}references?\b"


@dataclass(frozen=True)
class RelevanceOptions:
    pooled: int = 3  # units of a section that its score is pooled from; 0: all
    sharpness: float = 3.0
    rerank_sharpness: float = 5.0
    lexical_weight: float = 0.4
    dense_weight: float = 0.6
    section_bonus: float = 0.10
    object_bonus: float = 0.15
    most_bonus: float = 0.10
    named_bonus: float = 0.2  # for a section that the question names
    prior_bonus: float = 0.05
    structure_for_reranker: bool = False
    unscored_weight: float = 0.25  # of the lexical score of a unit that the reranker left out
    units: int = 0  # units kept; 0: all
    sections: int = 0  # sections kept where units aren't limited; 0: all
    pool: int = 64  # candidates of the reranker: best lexical ones,
    pool_per_section: int = 3  # of each section,
    pool_primary: int = 32  # and of objects of the asked type


def _flat(text: Column, gap: str = " ") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text_of(text)), "[^a-z0-9]+", gap), f"^{gap}+|{gap}+$", "")


def section_targets(question: Column) -> Column:
    """Kinds of sections that a question names as sections, references also by asking for one by number or how many there are."""
    q = _flat(question)
    found = F.array(*[F.when(q.rlike(rf"\b(?:{alias}\s+section|section\s+(?:on\s+)?{alias})\b"), F.lit(kind)) for alias, kind in SECTION_NAMES.items()], F.when(q.rlike(REFERENCE_INTENT), F.lit("references")))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def section_key(kind: Column, title: Column) -> Column:
    """What a question's named section is compared with: the section's type, else what its title is called, else the title."""
    own, t = _flat(kind, "_"), _flat(title)
    named = reduce(lambda c, x: c.when(t == x[0], x[1]), list(SECTION_NAMES.items())[1:], F.when(t == next(iter(SECTION_NAMES)), SECTION_NAMES[next(iter(SECTION_NAMES))]))
    return F.when((own != "") & (own != "unknown"), own).otherwise(named.otherwise(F.replace(t, F.lit(" "), F.lit("_"))))


def structural_key(kind: Column, title: Column) -> Column:
    """Finer than section_key() where the title tells."""
    t = _flat(title)
    first = reduce(lambda c, x: c.when(t.contains(x[0]), x[1]), TITLE_TERMS[1:], F.when(t.contains(TITLE_TERMS[0][0]), TITLE_TERMS[0][1]))
    return first.otherwise(section_key(kind, title))


def prior(primary: Column, key: Column) -> Column:
    """How likely evidence of the asked type is in a section of this kind, from 0 to 1."""
    out = F.lit(0.0)
    for kind, weights in PRIORS.items():
        own = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        out = F.when(primary == kind, F.coalesce(F.try_element_at(own, key), F.lit(0.0))).otherwise(out)
    return out


def _scaled(value: str, *by: str) -> Column:
    """value from 0 to 1 within `by`; all equal: one half; null stays null."""
    w = W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    same = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(F.col(value).isNull(), None).when(same, 0.5).otherwise((F.col(value) - low) / (high - low))


def _pooled(units: DataFrame, value: str, sharpness: float, top: int) -> DataFrame:
    """query_id, section_at, <value>_pool and <value>_n: the log-mean-exp of the best scores of each section's units, and how many have one."""
    w = W.partitionBy("query_id", "section_at")
    rows = units.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w.orderBy(F.desc(value)))).withColumn("_n", F.count("*").over(w)).withColumn("_top", F.max(value).over(w))
    rows = rows.where(F.col("_rn") <= top) if top > 0 else rows
    lme = F.max("_top") + F.log(F.avg(F.exp((F.col(value) - F.col("_top")) * sharpness))) / sharpness
    return rows.groupBy("query_id", "section_at").agg(lme.alias(f"{value}_pool"), F.max("_n").alias(f"{value}_n"))


def rerank_pool(units: DataFrame, questions: DataFrame, options: RelevanceOptions | None = None, explicit: Column | None = None) -> DataFrame:
    """The units that a reranker is to score: the lexically best of all, of each section and of objects of the asked type, and explicit ones (a condition)."""
    o = options or RelevanceOptions()
    best = [F.desc(F.coalesce("lexical", F.lit(0.0))), F.asc("section_at"), F.asc("unit_at")]
    rows = units.join(questions.select("query_id", F.concat(F.lit("object_"), F.coalesce("primary", F.lit(""))).alias("_kind")), "query_id")
    rows = rows.withColumn("_all", rank_by(["query_id"], *best)).withColumn("_own", rank_by(["query_id", "section_at"], *best)).withColumn("_typed", rank_by(["query_id", "kind"], *best))
    keep = (F.col("_all") <= o.pool) | (F.col("_own") <= o.pool_per_section) | ((F.col("kind") == F.col("_kind")) & (F.col("_typed") <= o.pool_primary))
    return rows.where(keep if explicit is None else keep | F.coalesce(explicit, F.lit(False))).drop("_kind", "_all", "_own", "_typed")


def section_relevance(units: DataFrame, questions: DataFrame, options: RelevanceOptions | None = None) -> DataFrame:
    """query_id, section_at, paper_id, section_id, score, rank, backend, status, base, named_bonus, prior_bonus, n_units, n_scored of every section, best first.

    A reranked section's score is that of its scored units (status partial if some have none); without any the question's fallback counts
    (status llmrerank_failed), or -1 (unavailable). Sections that the question names and kinds of sections where its evidence is likely get a bonus, under a reranker only if asked for.
    An unknown back end or fallback fails the read.
    """
    o = options or RelevanceOptions()
    heads = units.groupBy("query_id", "section_at").agg(*[F.first(c).alias(c) for c in ("paper_id", "section_id", "section_title", "section_type")], F.count("*").alias("n_units"))
    rows = heads
    for value, sharpness in (("lexical", o.sharpness), ("dense", o.sharpness), ("reranked", o.rerank_sharpness)):
        rows = rows.join(_pooled(units, value, sharpness, o.pooled), ["query_id", "section_at"], "left")
    zero = rows.withColumn("lexical_pool", F.coalesce("lexical_pool", F.lit(0.0)))
    rows = zero.withColumn("_b", _scaled("lexical_pool", "query_id")).withColumn("_e", F.coalesce(_scaled("dense_pool", "query_id"), F.lit(0.0))).join(questions.select("query_id", "question", "backend", F.coalesce("fallback", F.lit("none")).alias("fallback"), F.coalesce("primary", F.lit("")).alias("primary")), "query_id")
    checked = F.when(~F.col("backend").isin(*BACKENDS) | ~F.col("fallback").isin(*FALLBACKS), F.raise_error(F.concat_ws(" ", F.lit("unknown back end or fallback:"), "backend", "fallback"))).otherwise(F.col("backend"))
    rows = rows.withColumn("backend", checked)
    both = o.lexical_weight * F.col("_b") + o.dense_weight * F.col("_e")
    plain = lambda name: F.when(name == "e5_base_v2", F.col("_e")).when(name == "hybrid", both).when(name == "bm25", F.col("_b")).otherwise(-1.0)
    scored, rerank = F.coalesce("reranked_n", F.lit(0)), F.col("backend") == "llmrerank"
    base = F.when(rerank & (scored > 0), F.col("reranked_pool")).when(rerank, plain(F.col("fallback"))).otherwise(plain(F.col("backend")))
    used = F.when(rerank & (scored == 0) & (F.col("fallback") != "none"), F.concat("fallback", F.lit("_fallback"))).otherwise(F.col("backend"))
    status = F.when(~rerank, "ok").when(scored == F.col("n_units"), "ok").when(scored > 0, "partial").when(F.col("fallback") == "none", "unavailable").otherwise("llmrerank_failed")
    structure = ~rerank | F.lit(o.structure_for_reranker)
    named = F.when(structure & F.array_contains(section_targets(F.col("question")), section_key(F.col("section_type"), F.col("section_title"))), o.named_bonus).otherwise(0.0)
    likely = F.when(structure, o.prior_bonus * prior(F.col("primary"), structural_key(F.col("section_type"), F.col("section_title")))).otherwise(0.0)
    rows = rows.select("query_id", "section_at", "paper_id", "section_id", used.alias("backend"), status.alias("status"), base.alias("base"), named.alias("named_bonus"), likely.alias("prior_bonus"), "n_units", F.when(rerank, scored).otherwise(F.col("n_units")).alias("n_scored"))
    rows = rows.withColumn("score", F.round(F.col("base") + F.col("named_bonus") + F.col("prior_bonus"), 8))
    return rows.withColumn("rank", rank_by(["query_id"], F.desc("score"), F.asc(F.col("paper_id").cast("string")), F.asc(F.col("section_id").cast("string")), F.asc("section_at")))


def unit_relevance(units: DataFrame, questions: DataFrame, sections: DataFrame, options: RelevanceOptions | None = None) -> DataFrame:
    """query_id, unit_id, section_at, unit_at, local, local_backend, section_score, section_bonus, object_bonus, final, local_rank, final_rank, selected of every unit.

    A unit's own score is scaled over the question's units; a unit that the reranker left out has a part of its lexical one. The bonus follows its section's score
    (from 0 to 1), more of it for objects, up to a limit. sections: section_relevance() of the same.
    """
    o = options or RelevanceOptions()
    rows = units.withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    rows = rows.withColumn("_b", _scaled("lexical", "query_id")).withColumn("_e", F.coalesce(_scaled("dense", "query_id"), F.lit(0.0))).withColumn("_r", _scaled("reranked", "query_id"))
    rows = rows.join(questions.select("query_id", F.col("backend").alias("_backend")), "query_id").join(sections.select("query_id", "section_at", F.col("score").alias("section_score")), ["query_id", "section_at"])
    rerank = F.col("_backend") == "llmrerank"
    both = o.lexical_weight * F.col("_b") + o.dense_weight * F.col("_e")
    local = F.when(rerank & F.col("_r").isNotNull(), F.col("_r")).when(rerank, o.unscored_weight * F.col("_b")).when(F.col("_backend") == "e5_base_v2", F.col("_e")).when(F.col("_backend") == "hybrid", both).otherwise(F.col("_b"))
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("section_score")))
    bonus = F.least(F.lit(o.most_bonus), o.section_bonus * bounded)
    more = F.when(F.col("kind").startswith("object_"), F.greatest(F.lit(0.0), F.least(F.lit(o.most_bonus), o.object_bonus * bounded) - bonus)).otherwise(0.0)
    rows = rows.withColumn("local", F.round(local, 8)).withColumn("local_backend", F.when(rerank & F.col("_r").isNull(), "bm25_fallback").otherwise(F.col("_backend"))).withColumn("section_bonus", F.round(bonus, 8)).withColumn("object_bonus", F.round(more, 8))
    rows = rows.withColumn("final", F.round(F.col("local") + F.col("section_bonus") + F.col("object_bonus"), 8))
    order = [F.asc("section_at"), F.asc("unit_at")]
    rows = rows.withColumn("local_rank", rank_by(["query_id"], F.desc("local"), *order)).withColumn("final_rank", rank_by(["query_id"], F.desc("final"), *order))
    kept = F.col("final_rank") <= o.units if o.units > 0 else F.lit(True)
    return rows.select("query_id", "unit_id", "section_at", "unit_at", "local", "local_backend", "section_score", "section_bonus", "object_bonus", "final", "local_rank", "final_rank", kept.alias("selected"))


def context_sections(sections: DataFrame, ranked: DataFrame, options: RelevanceOptions | None = None) -> DataFrame:
    """sections with chosen (whether they are kept) and chosen_units, in order: those of selected units where units are limited, else the best sections with all their units."""
    o = options or RelevanceOptions()
    own = ranked.where("selected").groupBy("query_id", "section_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_at", "unit_id"))), lambda x: x["unit_id"]).alias("chosen_units"))
    rows = sections.join(own, ["query_id", "section_at"], "left")
    limited = F.col("chosen_units").isNotNull() if o.units > 0 else (F.col("rank") <= o.sections if o.sections > 0 else F.lit(True))
    return rows.withColumn("chosen", limited)
