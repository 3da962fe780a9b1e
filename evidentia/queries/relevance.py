"""Queries of section and unit relevance: a question for every supplier, its lines as units of twelve sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relevance as R
from ..session import table

QUERIES, SQL = {}, {}

_BACKEND = "CASE WHEN s_suppkey % 6 = 0 THEN 'bm25' WHEN s_suppkey % 6 = 1 THEN 'e5_base_v2' WHEN s_suppkey % 6 = 2 THEN 'hybrid' ELSE 'llmrerank' END"
_FALLBACK = "CASE WHEN s_suppkey % 12 = 11 THEN 'e5_base_v2' WHEN s_suppkey % 6 = 4 THEN 'bm25' WHEN s_suppkey % 6 = 5 THEN 'hybrid' ELSE 'none' END"
_PRIMARY = "CASE s_suppkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'equation_algorithm' WHEN 3 THEN 'citation_context' ELSE 'text_span' END"
_QUESTION = "CASE WHEN s_suppkey % 3 = 0 THEN 'What does the Results section say?' WHEN s_suppkey % 3 = 1 THEN 'Who wrote the 3rd cited reference?' ELSE 'Which model is best?' END"
_TITLE = "CASE l_partkey % 12 WHEN 0 THEN 'Results' WHEN 1 THEN '5 Ablation Study' WHEN 2 THEN 'References' WHEN 3 THEN 'Our Model' WHEN 4 THEN 'Introduction' WHEN 5 THEN 'Method' WHEN 6 THEN 'Appendix' ELSE 'Other matters' END"
_TYPE = "CASE l_partkey % 12 WHEN 0 THEN 'results' WHEN 1 THEN 'results' WHEN 3 THEN 'method' WHEN 5 THEN 'unknown' END"
_RERANKED = "CASE WHEN l_partkey % 12 >= 9 OR l_orderkey % 3 = 0 AND l_partkey % 12 < 5 THEN NULL ELSE l_tax * 10 END"

_POOL = "(SELECT q, sec, max(m) + ln(avg(exp((v - m) * {s}))) / {s} AS p, max(n) AS n FROM (SELECT q, sec, {v} AS v, max({v}) OVER w AS m, count(*) OVER w AS n, row_number() OVER (PARTITION BY q, sec ORDER BY {v} DESC) AS rn FROM u WHERE {v} IS NOT NULL WINDOW w AS (PARTITION BY q, sec)) WHERE rn <= 3 GROUP BY q, sec)"
_UNIT = "CASE WHEN abs(max({v}) OVER q - min({v}) OVER q) <= 1e-9 * greatest(abs(max({v}) OVER q), abs(min({v}) OVER q)) THEN 0.5e0 ELSE ({v} - min({v}) OVER q) / (max({v}) OVER q - min({v}) OVER q) END"
_PRIOR = " ".join(f"WHEN prim = '{kind}' AND key = '{key}' THEN {w}e0" for kind, own in R.PRIORS.items() for key, w in own.items())
_SECTIONS = f"""
WITH a AS (SELECT s_suppkey AS q, {_BACKEND} AS backend, {_FALLBACK} AS fallback, {_PRIMARY} AS prim, {_QUESTION} AS question FROM supplier),
u AS (SELECT l_suppkey AS q, l_orderkey * 10 + l_linenumber AS id, l_partkey, l_partkey % 12 AS sec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) AS pos, CASE WHEN l_partkey % 4 = 0 THEN 'object_table' ELSE 'text' END AS kind, CASE WHEN l_partkey % 7 = 0 THEN 0e0 ELSE l_quantity / 10e0 END AS b, l_discount * 10e0 AS e, {_RERANKED} AS r FROM lineitem),
p AS (SELECT h.*, coalesce(pb.p, 0) AS b, pe.p AS e, pr.p AS r, coalesce(pr.n, 0) AS scored FROM (SELECT q, sec, count(*) AS n FROM u GROUP BY ALL) h LEFT JOIN {_POOL.format(v='b', s='3e0')} pb USING (q, sec) LEFT JOIN {_POOL.format(v='e', s='3e0')} pe USING (q, sec) LEFT JOIN {_POOL.format(v='r', s='5e0')} pr USING (q, sec)),
n AS (SELECT *, {_UNIT.format(v='b')} AS nb, {_UNIT.format(v='e')} AS ne FROM p WINDOW q AS (PARTITION BY q)),
k AS (SELECT n.*, a.*, CASE sec WHEN 0 THEN 'results' WHEN 1 THEN 'ablation' WHEN 2 THEN 'references' WHEN 3 THEN 'model' WHEN 4 THEN 'introduction' WHEN 5 THEN 'methods' WHEN 6 THEN 'appendix' ELSE 'other_matters' END AS key FROM n JOIN a USING (q)),
f AS (SELECT *, CASE WHEN backend = 'llmrerank' AND scored > 0 THEN r WHEN (CASE WHEN backend = 'llmrerank' THEN fallback ELSE backend END) = 'bm25' THEN nb WHEN (CASE WHEN backend = 'llmrerank' THEN fallback ELSE backend END) = 'e5_base_v2' THEN ne WHEN (CASE WHEN backend = 'llmrerank' THEN fallback ELSE backend END) = 'hybrid' THEN 0.4e0 * nb + 0.6e0 * ne ELSE -1e0 END AS base,
  CASE WHEN backend <> 'llmrerank' AND (contains(question, 'Results') AND sec IN (0, 1) OR contains(question, 'reference') AND sec = 2) THEN 0.2e0 ELSE 0e0 END AS named, CASE WHEN backend = 'llmrerank' THEN 0e0 ELSE 0.05e0 * CASE {_PRIOR} ELSE 0e0 END END AS prior FROM k),
s AS (SELECT q, sec, CASE WHEN backend = 'llmrerank' AND scored = 0 AND fallback <> 'none' THEN fallback || '_fallback' ELSE backend END AS backend, CASE WHEN backend <> 'llmrerank' OR scored = n THEN 'ok' WHEN scored > 0 THEN 'partial' WHEN fallback = 'none' THEN 'unavailable' ELSE 'llmrerank_failed' END AS status, round(base + named + prior, 8) AS score, n, CASE WHEN backend = 'llmrerank' THEN scored ELSE n END AS scored FROM f)"""


def _inputs(spark, sf_dir):
    l, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    at = F.row_number().over(R.W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"))
    units = l.select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"), F.lit("p").alias("paper_id"), F.format_string("%02d", F.col("l_partkey") % 12).alias("section_id"), (F.col("l_partkey") % 12).alias("section_at"), at.alias("unit_at"),
        F.when(F.col("l_partkey") % 4 == 0, "object_table").otherwise("text").alias("kind"), F.expr(_TITLE).alias("section_title"), F.expr(_TYPE).alias("section_type"),
        F.when(F.col("l_partkey") % 7 == 0, 0.0).otherwise(F.col("l_quantity") / 10).alias("lexical"), (F.col("l_discount") * 10).alias("dense"), F.expr(_RERANKED).alias("reranked"),
    )
    return units, s.select(F.col("s_suppkey").alias("query_id"), F.expr(_QUESTION).alias("question"), F.expr(_BACKEND).alias("backend"), F.expr(_FALLBACK).alias("fallback"), F.expr(_PRIMARY).alias("primary"))


def section_relevance(spark, sf_dir):
    return R.section_relevance(*_inputs(spark, sf_dir)).select("query_id", "section_at", "backend", "status", F.round("score", 5).alias("score"), "n_units", "n_scored")


QUERIES["section_relevance"] = section_relevance
SQL["section_relevance"] = _SECTIONS + " SELECT q AS query_id, sec AS section_at, backend, status, round(score, 5) AS score, n AS n_units, scored AS n_scored FROM s"


def unit_relevance(spark, sf_dir):
    units, questions = _inputs(spark, sf_dir)
    rows = R.unit_relevance(units, questions, R.section_relevance(units, questions))
    return rows.select("query_id", "unit_id", "unit_at", "local_backend", F.round("local", 5).alias("local"), F.round("final", 5).alias("final"), F.round("object_bonus", 5).alias("object_bonus"))


QUERIES["unit_relevance"] = unit_relevance
SQL["unit_relevance"] = _SECTIONS + f""", v AS (SELECT u.q, id, pos, kind, backend AS asked, r, {_UNIT.format(v='b')} AS nb, {_UNIT.format(v='e')} AS ne, {_UNIT.format(v='r')} AS nr, sec FROM u JOIN a USING (q) WINDOW q AS (PARTITION BY q)),
w AS (SELECT v.*, CASE WHEN asked = 'llmrerank' AND r IS NOT NULL THEN nr WHEN asked = 'llmrerank' THEN 0.25e0 * nb WHEN asked = 'e5_base_v2' THEN ne WHEN asked = 'hybrid' THEN 0.4e0 * nb + 0.6e0 * ne ELSE nb END AS local, least(1e0, greatest(0e0, s.score)) AS x FROM v JOIN s ON s.q = v.q AND s.sec = v.sec),
z AS (SELECT *, least(0.1e0, 0.1e0 * x) AS bonus, CASE WHEN kind = 'text' THEN 0e0 ELSE greatest(0e0, least(0.1e0, 0.15e0 * x) - least(0.1e0, 0.1e0 * x)) END AS more FROM w)
SELECT q AS query_id, id AS unit_id, pos AS unit_at, CASE WHEN asked = 'llmrerank' AND r IS NULL THEN 'bm25_fallback' ELSE asked END AS local_backend, round(local, 5) AS local, round(local + bonus + more, 5) AS final, round(more, 5) AS object_bonus FROM z"""
