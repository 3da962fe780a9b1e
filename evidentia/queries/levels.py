"""Queries of the evidence hierarchy: every order is a question whose selected records are its lines, and every supplier's lines are a paper."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import levels as H
from ..session import staged, table
from .fixtures import SQL_LINES, lines

QUERIES, SQL = {}, {}

_TEXT = "CASE l_partkey % 4 WHEN 1 THEN concat('Parts of ', l_mode, chr(10), 'x | y', chr(10), '1 | ', l_linenumber) WHEN 2 THEN concat('A Figure of the ', l_mode, ' and  more words than an excerpt has') ELSE concat('Line ', l_linenumber, ' by ', l_mode) END"
_KIND = "CASE l_partkey % 4 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' ELSE 'reference' END"
_BASE = f"""
WITH {SQL_LINES}, r AS (SELECT l_suppkey AS paper, l_orderkey || '-' || l_linenumber AS id, l_orderkey AS q, l_linenumber AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS pos, l_partkey % 5 AS sec, l_partkey % 4 AS k, {_TEXT} AS text FROM lines),
s AS (SELECT *, (pos - 1) // 20 + 1 AS page FROM r),
pairs AS (SELECT a.q, a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY a.sec <> b.sec, a.page <> b.page, abs(a.pos - b.pos), b.pos) AS place FROM s a JOIN s b ON a.paper = b.paper AND a.id <> b.id AND abs(a.pos - b.pos) <= 200),
near AS (SELECT * FROM pairs WHERE place <= 2),
roles AS (SELECT q, id, min(role) AS role FROM (SELECT q, id, 'selected_anchor' AS role FROM s UNION ALL SELECT q, b, 'zz' FROM near) GROUP BY ALL),
c AS (SELECT x.q, x.id, CASE WHEN x.role = 'zz' THEN 'l1_context' ELSE x.role END AS role, s.* EXCLUDE (q, id), 'E' || lpad((row_number() OVER (PARTITION BY x.q ORDER BY pos, page, x.id))::VARCHAR, 4, '0') AS ref, CASE k WHEN 0 THEN 'text_span' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' ELSE 'citation_context' END AS kind, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM roles x JOIN s ON s.id = x.id),
e AS (SELECT *, CASE WHEN length(flat) <= 24 THEN flat ELSE rtrim(substr(flat, 1, 21)) || '...' END AS excerpt FROM c)"""


def _levels(spark, sf_dir):
    rows, n = lines(spark, sf_dir), F.col("l_linenumber")
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    none = F.lit(None).cast("string")
    records = staged(rows.withColumn("at", at).select(
        F.col("l_suppkey").alias("paper_id"), F.concat_ws("-", "l_orderkey", n).alias("record_id"), F.col("at").cast("long").alias("at"), (F.floor((F.col("at") - 1) / 20) + 1).alias("page"), (F.col("l_partkey") % 5).cast("string").alias("section_id"), F.concat(F.lit("Section "), F.col("l_partkey") % 5).alias("section_title"),
        F.lit(None).cast("array<string>").alias("section_path"), F.expr(_KIND).alias("record_type"), none.alias("source_type"), none.alias("label"), F.expr(_TEXT).alias("text"), F.when(F.col("l_suppkey") % 2 == 0, "x.png").alias("crop_path"), none.alias("citation_id"), F.col("l_orderkey").alias("query_id"), n.cast("long").alias("place"), F.lit(None).cast("long").alias("selection_rank"),
    ), "records")
    o = table(spark, sf_dir, "orders")
    questions = o.select(F.col("o_orderkey").alias("query_id"), F.lit("What is it?").alias("question"))
    papers = records.select("query_id", "paper_id").distinct().select("query_id", "paper_id", F.concat(F.lit("Supplier "), "paper_id").alias("title"), F.lit("An abstract").alias("abstract"))
    level0, links = H.catalog_levels(records, questions, papers, records.drop("query_id", "place", "selection_rank"))
    return level0, links, papers


def evidence_level0(spark, sf_dir):
    return _levels(spark, sf_dir)[0].select("query_id", "evidence_ref", "record_id", "role", "kind", "selection_rank")


QUERIES["evidence_level0"], SQL["evidence_level0"] = evidence_level0, _BASE + " SELECT q AS query_id, ref AS evidence_ref, id AS record_id, role, kind, CASE WHEN role = 'selected_anchor' THEN n END AS selection_rank FROM e"


def evidence_level1(spark, sf_dir):
    level0, links, _ = _levels(spark, sf_dir)
    rows = H.contexts(level0, links, most=24)
    grid = F.concat_ws("/", F.col("table.caption"), F.array_join("table.columns", ","), F.array_join(F.transform("table.rows", lambda r: F.array_join(r, ",")), ";"))
    shown = F.when(F.col("table").isNotNull(), grid).when(F.col("figure").isNotNull(), F.concat_ws("/", "figure.caption", F.col("figure.has_crop").cast("string"))).otherwise(F.col("citation"))
    return rows.select("query_id", "anchor_ref", F.array_join("heading_path", ">").alias("heading"), F.array_join("neighbor_refs", ",").alias("refs"), F.array_join("neighbor_excerpts", "|").alias("excerpts"), shown.alias("context"))


QUERIES["evidence_level1"] = evidence_level1
SQL["evidence_level1"] = _BASE + """ SELECT a.q AS query_id, a.ref AS anchor_ref, 'Section ' || any_value(a.sec) AS heading, coalesce(string_agg(b.ref, ',' ORDER BY near.place), '') AS refs, coalesce(string_agg(b.excerpt, '|' ORDER BY near.place), '') AS excerpts,
  any_value(CASE a.kind WHEN 'table' THEN split_part(a.text, chr(10), 1) || '/x,y/1,' || a.n WHEN 'figure' THEN a.excerpt || '/' || (a.paper % 2 = 0) WHEN 'citation_context' THEN a.excerpt END) AS context
  FROM e a LEFT JOIN near ON near.a = a.id LEFT JOIN e b ON b.q = a.q AND b.id = near.b WHERE a.role = 'selected_anchor' GROUP BY a.q, a.ref"""


def evidence_level3(spark, sf_dir):
    level0, _, papers = _levels(spark, sf_dir)
    level0 = staged(level0.select("query_id", "evidence_ref", "role", "kind", "paper_id", "section_id", "section_title", "text"), "level0")  # read for each part
    counted, sections, mentions = H.navigation_levels(level0, papers, chars=8)
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit(" "), x["value"])), ",")
    out = counted.select("query_id", F.concat_ws("/", F.lit("paper"), "paper_id", "title", "abstract_preview", told("counts")).alias("entry"))
    out = out.unionByName(sections.select("query_id", F.concat_ws("/", F.lit("section"), "paper_id", "section_id", "section_title", F.array_join("anchor_refs", ","), told("counts")).alias("entry")))
    return out.unionByName(mentions.select("query_id", F.concat_ws("/", F.lit("mention"), "place", "evidence_ref", "entity").alias("entry")))


QUERIES["evidence_level3"] = evidence_level3
SQL["evidence_level3"] = _BASE + """, g AS (SELECT q, paper, sec, kind, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT q, paper, kind, sum(n) AS n FROM g GROUP BY ALL),
 m AS (SELECT q, ref, w, pos FROM (SELECT q, ref, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM (SELECT q, ref, list_distinct_kept AS x FROM (SELECT q, ref, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_slice(regexp_extract_all(flat, '\\b(?:[A-Z][A-Za-z0-9_-]{1,}|[A-Z]{2,}[A-Z0-9_-]*)\\b'), 1, 8), lambda z: [z])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS list_distinct_kept FROM e)))),
 p AS (SELECT q, ref, w, row_number() OVER (PARTITION BY q ORDER BY ref, pos) AS place FROM m)
 SELECT q AS query_id, 'paper/' || paper || '/Supplier ' || paper || '/An ab.../' || string_agg(kind || ' ' || n, ',' ORDER BY kind) AS entry FROM h GROUP BY q, paper
 UNION ALL SELECT g.q, 'section/' || g.paper || '/' || g.sec || '/Section ' || g.sec || '/' || any_value(coalesce(a.refs, '')) || '/' || string_agg(g.kind || ' ' || g.n, ',' ORDER BY g.kind) FROM g LEFT JOIN (SELECT q, paper, sec, string_agg(ref, ',' ORDER BY ref) AS refs FROM e WHERE role = 'selected_anchor' GROUP BY ALL) a ON a.q = g.q AND a.paper = g.paper AND a.sec = g.sec GROUP BY g.q, g.paper, g.sec
 UNION ALL SELECT q, 'mention/' || place || '/' || ref || '/' || w FROM p WHERE place <= 160"""
