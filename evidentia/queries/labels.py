"""Queries of the F.col("label"), locator and question functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import prompts as P
from ..session import table
from .fixtures import SQL_LABELS, SQL_PAPERS, SQL_QUESTIONS, labelled, papers, questions

QUERIES, SQL = {}, {}


def _simple(name, source, columns, sql):
    def run(spark, sf_dir):
        return source(spark, sf_dir).select(*columns())

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


def _case(pairs, value, default):
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


_TYPE = _case(L.TYPE_ALIASES, "lower(trim(kind))", "lower(trim(kind))")
_ISIN = ", ".join(f"'{t}'" for t in L.OFFICIAL_TYPES)

_simple("official_source_type", lambda s, d: labelled(s, d).withColumn("given", F.when(F.col("record_id") % 3 == 0, F.lit("figure")).when(F.col("record_id") % 3 == 1, F.lit("other"))), lambda: ["record_id", L.official_type(F.col("kind"), F.col("given")).alias("official"), L.source_type(F.col("kind")).alias("normalized")], f"""
WITH {SQL_LABELS}, g AS (SELECT *, CASE record_id % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'other' ELSE '' END AS given FROM labelled)
SELECT record_id, CASE WHEN given IN ({_ISIN}) THEN given ELSE {_case(L.TYPE_OF_RECORD, 'kind', 'NULL')} END AS official, {_TYPE} AS normalized FROM g""")

_CITE = "coalesce(try_cast(coalesce(nullif(regexp_extract(trim(label), '(?i)\\b(?:reference|ref\\.?|citation)\\s*\\[?\\s*(\\d{1,4})\\s*\\]?', 1), ''), nullif(regexp_extract(trim(label), '\\[\\s*(\\d{1,4})\\s*\\]', 1), ''), nullif(regexp_extract(trim(label), '^\\s*(\\d{1,4})\\s*$', 1), '')) AS INTEGER)::VARCHAR, trim(label))"
_simple("citation_ids", labelled, lambda: ["record_id", L.citation_id(F.col("label")).alias("citation_id"), L.grounding_kind(L.source_type(F.col("kind")), F.col("label")).alias("field")], f"""
WITH {SQL_LABELS} SELECT record_id, {_CITE} AS citation_id, CASE WHEN trim(label) = '' THEN NULL WHEN {_TYPE} = 'table' THEN 'table_id' WHEN {_TYPE} = 'figure' THEN 'figure_id'
  WHEN {_TYPE} = 'equation_algorithm' AND contains(lower(label), 'algorithm') THEN 'algorithm_id' WHEN {_TYPE} = 'equation_algorithm' THEN 'equation_id' WHEN {_TYPE} = 'citation_context' THEN 'citation_id' END AS field FROM labelled""")

_F = lambda p: f"nullif(regexp_extract(t, '{p}', 1), '')"
_B = lambda e: f"regexp_replace({e}, '[.,;:]+$', '')"
_simple("normalize_labels", labelled, lambda: ["record_id", L.label(F.col("label"), F.col("kind")).alias("normalized")], f"""
WITH {SQL_LABELS}, n AS (SELECT record_id, trim(regexp_replace(label, '\\s+', ' ', 'g')) AS t, {_TYPE} AS k FROM labelled)
SELECT record_id, CASE k WHEN 'table' THEN coalesce('Table ' || {_B(_F('(?i)\\b(?:table|tab\\.)\\s*([A-Za-z0-9.\\-]+)'))}, t)
  WHEN 'figure' THEN coalesce('Figure ' || {_B(_F('(?i)\\b(?:figure|fig\\.)\\s*([A-Za-z0-9.\\-]+)'))}, t)
  WHEN 'equation_algorithm' THEN coalesce('Algorithm ' || {_B(_F('(?i)\\balgorithm\\s*([A-Za-z0-9.\\-]+)'))}, 'Equation ' || {_B('coalesce(' + _F('(?i)\\b(?:equation|eq\\.)\\s*\\(?([A-Za-z0-9.\\-]+)\\)?') + ', ' + _F('^\\(?([0-9]+[A-Za-z]?)\\)?$') + ')')}, t)
  WHEN 'citation_context' THEN coalesce('Reference ' || coalesce({_F('(?i)\\breference\\s*([0-9]{1,4})\\b')}, {_F('\\[([0-9]{1,4})\\]')}, {_F('(?i)\\b([0-9]{1,4})(?:st|nd|rd|th)\\s+reference\\b')}, {_F('^\\s*([0-9]{1,4})\\s*$')})::INTEGER::VARCHAR, t) ELSE t END AS normalized FROM n""")

_N = "regexp_replace(regexp_replace(lower(trim(label)), '^[\"''“”‘’`]+|[\"''“”‘’`]+$', '', 'g'), '\\s+', ' ', 'g')"
_V = lambda p: f"coalesce('{p} ' || nullif(regexp_extract({_N}, '^(?:{p}\\s*)?(\\d+[a-z]?)$', 1), ''), {_N})"
_simple("evidence_keys", labelled, lambda: ["record_id", *[L.evidence_key(F.concat(F.lit("p"), F.col("record_id") % 50), L.source_type(F.col("kind")), F.col("record_id") % 4, F.lit("Results"), F.col("label"), F.col("label"), F.col("label"), F.lit(None).cast("string"), F.col("label"))[c].alias(c) for c in ("paper_id", "source_type", "location", "object_id")]], f"""
WITH {SQL_LABELS} SELECT record_id, concat('p', record_id % 50) AS paper_id, {_TYPE} AS source_type, CASE WHEN record_id % 4 = 0 THEN 'Results' ELSE (record_id % 4)::VARCHAR END AS location,
  CASE {_TYPE} WHEN 'table' THEN {_V('table')} WHEN 'figure' THEN {_V('figure')} WHEN 'equation_algorithm' THEN {_V('equation')} WHEN 'citation_context' THEN {_V('citation')} ELSE '' END AS object_id FROM labelled""")

_SEC = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{p}')" for p in parts) + f" THEN '{n}'" for n, parts in L.SECTION_TYPES) + " ELSE 'unknown' END"
_HEAD = "concat(p_size, '.', p_partkey % 3, ' ', CASE p_partkey % 12 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'Introduction' WHEN 2 THEN 'Related Work' WHEN 3 THEN 'Our Approach' WHEN 4 THEN 'Experimental Setup' WHEN 5 THEN 'Ablation Study' WHEN 6 THEN 'Discussion' WHEN 7 THEN 'Conclusions' WHEN 8 THEN 'References' WHEN 9 THEN 'Supplementary' WHEN 10 THEN 'Front matter' ELSE p_name END)"
_simple("section_types", lambda s, d: table(s, d, "part").select("p_partkey", F.expr(_HEAD).alias("title")), lambda: ["p_partkey", L.section_type(F.col("title")).alias("section_type")], f"""
WITH h AS (SELECT p_partkey, lower(regexp_replace(trim({_HEAD}), '^\\d+(?:\\.\\d+)*\\.?\\s+', '')) AS t FROM part) SELECT p_partkey, {_SEC} AS section_type FROM h""")

_MULTI = " OR ".join(f"regexp_matches(lower(question), '{p}')" for p in L.MULTI_PAPER)
_simple("question_routing", questions, lambda: ["query_id", F.array_join(L.numbered_types(F.col("question")), ",").alias("types"), L.is_multi_paper(F.col("question")).alias("multi_paper"), L.operation(F.col("question")).alias("operation"), F.array_join(L.object_label(F.col("question")), ",").alias("objects")], f"""
WITH {SQL_QUESTIONS}, o AS (SELECT query_id, question, regexp_extract_all(question, '{L.NUMBERED_OBJECT}', 1) AS w, regexp_extract_all(question, '{L.NUMBERED_OBJECT}', 0) AS m FROM questions),
t AS (SELECT query_id, w, CASE WHEN lower(w) = 'table' THEN 'table' WHEN starts_with(lower(w), 'fig') THEN 'figure' ELSE 'equation_algorithm' END AS t, k FROM (SELECT query_id, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM o)),
d AS (SELECT query_id, t, min(k) AS k FROM t GROUP BY ALL UNION ALL SELECT query_id, 'citation_context', 99 FROM questions WHERE regexp_matches(question, '{L.NUMBERED_REFERENCE}')),
l AS (SELECT DISTINCT query_id, CASE WHEN starts_with(lower(m), 'fig') THEN 'figure' WHEN starts_with(lower(m), 'eq') THEN 'equation' WHEN starts_with(lower(m), 't') THEN 'table' ELSE 'algorithm' END || ' ' || regexp_extract(m, '(\\d{{1,4}})', 1) AS x FROM (SELECT query_id, unnest(m) AS m FROM o))
SELECT query_id, coalesce((SELECT string_agg(t, ',' ORDER BY k) FROM d WHERE d.query_id = q.query_id), '') AS types, ({_MULTI}) AS multi_paper,
  CASE WHEN regexp_matches(lower(question), '\\bhow many\\b|\\bnumber of\\b|\\bcount\\b') THEN 'count' WHEN regexp_matches(lower(question), '\\bdifference\\b|\\bhow much (?:higher|lower|more|less|better)\\b|\\bimprovement\\b') THEN 'difference'
   WHEN regexp_matches(lower(question), '\\bhighest\\b|\\bmaximum\\b|\\bbest\\b|\\blargest\\b|\\bmost\\b') THEN 'maximum' WHEN regexp_matches(lower(question), '\\blowest\\b|\\bminimum\\b|\\bsmallest\\b|\\bleast\\b') THEN 'minimum' ELSE 'direct' END AS operation,
  coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM l WHERE l.query_id = q.query_id), '') AS objects FROM questions q""")

_simple("question_targets", questions, lambda: ["query_id", *[L.targets(F.col("question"))[c].alias(c) for c in ("table_id", "figure_id", "equation_id", "algorithm_id", "citation_id", "last_reference")]], f"""
WITH {SQL_QUESTIONS} SELECT query_id, nullif(regexp_extract(question, '(?i)\\btable\\s*(\\d+[A-Za-z]?)', 1), '') AS table_id, nullif(regexp_extract(question, '(?i)\\bfig(?:ure|\\.)?\\s*(\\d+[A-Za-z]?)', 1), '') AS figure_id,
  nullif(regexp_extract(question, '(?i)\\beq(?:uation|\\.)?\\s*\\(?(\\d+)\\)?', 1), '') AS equation_id, nullif(regexp_extract(question, '(?i)\\balgorithm\\s*(\\d+)', 1), '') AS algorithm_id,
  coalesce(nullif(regexp_extract(question, '(?i)\\breference\\s*\\[?(\\d+)\\]?', 1), ''), nullif(regexp_extract(question, '(?i)\\b(\\d+)(?:st|nd|rd|th)\\s+(?:reference|citation)\\b', 1), '')) AS citation_id,
  regexp_matches(lower(question), '\\blast (?:reference|citation)\\b|\\bfinal reference\\b') AS last_reference FROM questions""")

_PAIR = "o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(o_custkey, '%') WHEN 2 THEN o_orderstatus WHEN 3 THEN concat(' ', o_orderpriority) ELSE '' END AS gold, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat(o_custkey, '.0000001') WHEN 2 THEN lower(o_orderstatus) WHEN 3 THEN upper(o_orderpriority) WHEN 4 THEN concat(o_custkey, '') ELSE '' END AS pred, CASE o_orderkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' ELSE 'string' END AS kind"
_NG = lambda c: f"regexp_replace(regexp_replace(lower(trim({c})), '^[\"''“”‘’`]+|[\"''“”‘’`]+$', '', 'g'), '\\s+', ' ', 'g')"
_simple("cell_equality", lambda s, d: table(s, d, "orders").selectExpr(*[x if " AS " not in x else x for x in ["o_orderkey", *[y.strip() for y in _PAIR.split("o_orderkey, ", 1)[1].replace(" AS gold, ", " AS gold\n").replace(" AS pred, ", " AS pred\n").split("\n")]]]), lambda: ["o_orderkey", L.cell_equal(F.col("gold"), F.col("pred"), F.col("kind")).alias("equal")], f"""
WITH c AS (SELECT {_PAIR} FROM orders), n AS (SELECT *, try_cast(replace(trim(gold), '%', '') AS DOUBLE) AS a, try_cast(replace(trim(pred), '%', '') AS DOUBLE) AS b FROM c)
SELECT o_orderkey, CASE WHEN gold IS NULL OR pred IS NULL THEN gold IS NULL AND pred IS NULL WHEN kind = 'number' THEN coalesce(abs(a - b) <= greatest(1e-6 * greatest(abs(a), abs(b)), 1e-6), false)
  WHEN kind = 'boolean' THEN (gold <> '') = (pred <> '') ELSE {_NG('gold')} = {_NG('pred')} END AS equal FROM n""")

_simple("source_ladder", lambda s, d: table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://arxiv.org/abs/2401.0"), F.col("page_id"))).when(F.col("page_id") % 5 == 1, "").otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 == 0, "EMNLP Findings").otherwise("").alias("venue")), lambda: ["page_id", L.paper_source(F.col("url"), F.col("venue")).alias("source")], """
WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://arxiv.org/abs/2401.0' || page_id WHEN 1 THEN '' ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN 'EMNLP Findings' ELSE '' END AS venue FROM pages), l AS (SELECT *, lower(venue || ' ' || url) AS t FROM u)
SELECT page_id, CASE WHEN contains(t, 'openreview.net') THEN 'OpenReview' WHEN contains(t, 'arxiv.org') THEN 'arXiv' """ + " ".join(f"WHEN contains(t, '{v.lower()}') THEN '{v}'" for v in L.SOURCE_VENUES) + r""" WHEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) <> '' THEN lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ELSE 'unknown' END AS source FROM l""")

_simple("projected_candidates", lambda s, d: P.candidate_view(papers(s, d), "paper_id"), lambda: ["paper_id", "title", "abstract"], f"""
WITH {SQL_PAPERS} SELECT paper_id, substr(title, 1, 120) AS title, CASE WHEN paper_id <= 60 THEN substr(abstract, 1, 200) ELSE '' END AS abstract FROM papers""")


_simple("openreview_filter", lambda s, d: L.without_openreview(table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://OpenReview.net/forum?id="), F.col("page_id"))).otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 7 == 0, "openreview.net workshop").otherwise("ACL").alias("venue"))), lambda: ["page_id"], """
SELECT page_id FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0""")
