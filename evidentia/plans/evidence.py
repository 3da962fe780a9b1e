"""From questions and documents to selected evidence, for all questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L, text as T
from ..operators import bm25, scoring as S, sections as X, selection as Y
from ..sources.providers import score_pairs, token_f1_scorer


@dataclass(frozen=True)
class EvidenceOptions:
    top_papers: int = 5
    units_per_paper: int = 24
    packages: int = 12
    least_packages: int = 4
    page_cap: int = 2
    context_chars: int = 80_000
    target_tokens: int = 1280
    most_tokens: int = 1536


def records_of(papers: DataFrame) -> DataFrame:
    """paper_id, record_id, page, kind, text: the non-empty lines of each paper (paper_id, text) as records."""
    lines = papers.select("paper_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("page", "text")).where(F.trim("text") != "")
    kind = F.when(F.col("text").contains("|"), "table").when(F.col("text").rlike(r"^\s*\[\d+\]"), "citation_context").otherwise("text_span")
    return lines.select("paper_id", F.format_string("%s::p%03d_r%04d", F.col("paper_id").cast("string"), F.col("page"), F.col("page")).alias("record_id"), "page", kind.alias("kind"), "text")


def evidence(questions: DataFrame, papers: DataFrame, options: EvidenceOptions | None = None, scorer=token_f1_scorer) -> DataFrame:
    """query_id, place, paper_id, record_id, kind, score, text: BM25 picks papers, the scorer ranks their records, greedy packages are chosen.

    questions: query_id, question; papers: paper_id, text.
    """
    o = options or EvidenceOptions()
    asked = questions.select("query_id", F.col("question").alias("text"))
    top = bm25.top_k(bm25.bm25_scores(papers, asked, doc_key="paper_id", query_key="query_id"), o.top_papers, query_key="query_id", doc_key="paper_id")
    chosen = papers.join(top.select("paper_id").distinct(), "paper_id", "left_semi")
    pairs = top.select("query_id", "paper_id").join(records_of(chosen), "paper_id").join(asked.withColumnRenamed("text", "question"), "query_id")
    scored = score_pairs(pairs, scorer, query="question", document="text").withColumn("score", F.round("score", 6))
    best = scored.withColumn("rn", S.rank_by(["query_id", "paper_id"], F.desc("score"), F.asc("record_id"))).where(F.col("rn") <= o.units_per_paper)
    packages = best.select("query_id", F.col("record_id").alias("package_id"), "paper_id", "page", "kind", "score", F.length("text").alias("size"))
    picked = Y.greedy_packages(packages, "query_id", most=o.packages, least=o.least_packages, page_cap=o.page_cap, chars=o.context_chars)
    return picked.join(best.select("query_id", F.col("record_id").alias("package_id"), "paper_id", "kind", "score", "text"), ["query_id", "package_id"]).withColumnRenamed("package_id", "record_id")


def routed(questions: DataFrame) -> DataFrame:
    """questions with the routing a plan needs: targets, types, whether several papers are meant, the operation, terms and mentions."""
    q = F.col("question")
    return questions.select("*", L.targets(q).alias("targets"), L.numbered_types(q).alias("types"), L.is_multi_paper(q).alias("multi_paper"), L.operation(q).alias("operation"), T.query_terms(q).alias("terms"), T.query_mentions(q).alias("mentions"))


def units(records: DataFrame, options: EvidenceOptions | None = None) -> DataFrame:
    """Token-bounded units of the records of each paper."""
    o = options or EvidenceOptions()
    return X.pack_units(records.withColumn("at", F.col("page")), "paper_id", "at", target=o.target_tokens, most=o.most_tokens)
