"""Queries of grounding, transcription, page scoring and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grounding as G, tables as B, transcription as R
from ..session import table
from .fixtures import SQL_LABELS, SQL_QUESTIONS, labelled, questions

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_VERB = "CASE p_partkey % 8 WHEN 0 THEN 'Outperforms' WHEN 1 THEN 'has a score of' WHEN 2 THEN 'is  higher than' WHEN 3 THEN 'we define' WHEN 4 THEN 'used' WHEN 5 THEN 'uses' WHEN 6 THEN p_type ELSE '' END"
_FLAT = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


@_query(f"WITH v AS (SELECT p_partkey, {_FLAT(_VERB)} AS v FROM part) SELECT p_partkey, CASE WHEN v IN ({', '.join(repr(p) for p in G.PREDICATES)}) THEN v " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{n}'" for p, n in G.PREDICATE_WORDS) + " ELSE '' END AS predicate FROM v")
def canonical_predicates(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.predicate(F.expr(_VERB)).alias("predicate"))


_RAW = "CASE c_custkey % 6 WHEN 0 THEN 'b' WHEN 1 THEN 'Option C' WHEN 2 THEN 'the machinery one' WHEN 3 THEN '' WHEN 4 THEN 'answer: Z' ELSE 'FURNITURE' END"
_OPTIONS = (("A", "automobile"), ("B", "building"), ("C", "machinery"), ("D", "household goods"))
_BY_KEY = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{k}'" for k, _ in _OPTIONS) + " END"
_NEAR = "CASE WHEN {0} = '' THEN NULL " + " ".join(f"WHEN contains('{t}', {{0}}) OR contains({{0}}, '{t}') THEN '{k}'" for k, t in _OPTIONS) + " END"


@_query(f"""
WITH r AS (SELECT c_custkey, {_RAW} AS raw, c_mktsegment AS free FROM customer), u AS (SELECT *, upper(trim(raw)) AS up FROM r)
SELECT c_custkey, coalesce({_BY_KEY.format('up')}, {_BY_KEY.format("regexp_extract(up, '\\b(?:OPTION|ANSWER|CHOICE)?\\s*([A-Z])\\b', 1)")}, {_NEAR.format(_FLAT('raw'))}, {_NEAR.format(_FLAT('free'))}, '') AS choice FROM u""")
def choice_inference(spark, sf_dir):
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in _OPTIONS])
    return table(spark, sf_dir, "customer").select("c_custkey", G.infer_choice(F.expr(_RAW), F.col("c_mktsegment"), options).alias("choice"))


_FACT = "CASE doc_id % 4 WHEN 0 THEN substr(text, 3, 12) WHEN 1 THEN concat(doc_id, ' and 12.5') WHEN 2 THEN 'nothing of this' ELSE '' END"


@_query(f"""
WITH f AS (SELECT doc_id, {_FLAT(_FACT)} AS c, {_FLAT('text')} AS s FROM documents), n AS (SELECT *, regexp_extract_all(c, '[-+]?\\d+(?:\\.\\d+)?') AS num, coalesce(list_aggregate(list_filter(regexp_extract_all(c, '[a-z0-9]+'), lambda t: length(t) >= 3), 'string_agg', ' '), '') AS w FROM f)
SELECT doc_id, CASE WHEN c = '' OR s = '' THEN false WHEN contains(s, c) THEN true WHEN len(num) > 0 THEN len(list_filter(num, lambda x: NOT list_contains(regexp_extract_all(s, '[-+]?\\d+(?:\\.\\d+)?'), x))) = 0 ELSE w <> '' AND contains(coalesce(list_aggregate(regexp_extract_all(s, '[a-z0-9]+'), 'string_agg', ' '), ''), w) END AS supported FROM n""")
def fact_support(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.fact_supported(F.expr(_FACT), F.col("text")).alias("supported"))


@_query("""
WITH p AS (SELECT c_custkey, c_mktsegment, o_orderpriority AS opt, c_name || ' ' || c_mktsegment || ' 1-URGENT 3' AS ev FROM customer JOIN orders ON c_custkey = o_custkey),
b AS (SELECT DISTINCT c_custkey, opt, trim(regexp_replace(lower(opt), '[^a-z0-9.]+', ' ', 'g')) AS o, trim(regexp_replace(lower(ev), '[^a-z0-9.]+', ' ', 'g')) AS e, list_distinct(regexp_extract_all(lower(opt), '[a-z0-9]+')) AS ot, list_distinct(regexp_extract_all(lower(ev), '[a-z0-9]+')) AS et, list_distinct(regexp_extract_all(lower(c_mktsegment), '[a-z0-9]+')) AS qt, ev FROM p),
x AS (SELECT *, list_filter(ot, lambda t: NOT list_contains(qt, t)) AS own FROM b)
SELECT c_custkey, opt, round(CASE WHEN o <> '' AND contains(e, o) THEN 10e0 + least(5e0, length(o) / 20e0) ELSE 0e0 END + CASE WHEN len(ot) = 0 THEN 0e0 ELSE 3e0 * len(list_intersect(ot, et)) / len(ot) END + CASE WHEN len(own) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect(own, et)) / len(own) END
  + 2e0 * len(list_filter(regexp_extract_all(opt, '[-+]?\\d+(?:\\.\\d+)?'), lambda n: list_contains(regexp_extract_all(ev, '\\d+(?:\\.\\d+)?'), regexp_replace(n, '^[-+]', '')))), 6) AS support FROM x""")
def option_support(spark, sf_dir):
    return _support(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))


def _support(c, o):
    rows = c.join(o, c["c_custkey"] == o["o_custkey"]).select("c_custkey", "c_mktsegment", F.col("o_orderpriority").alias("opt"), F.concat_ws(" ", "c_name", "c_mktsegment", F.lit("1-URGENT 3")).alias("ev")).distinct()
    return rows.select("c_custkey", "opt", F.round(G.option_support(F.col("opt"), F.col("ev"), F.col("c_mktsegment")), 6).alias("support"))


_ELEMENT = "CASE p_partkey % 9 WHEN 0 THEN 'Table' WHEN 1 THEN 'picture' WHEN 2 THEN 'formula' WHEN 3 THEN 'code' ELSE 'text' END"
_TEXT = "CASE p_partkey % 9 WHEN 3 THEN concat('Algorithm ', p_size) WHEN 4 THEN '3.1 Experiments' WHEN 5 THEN 'n/a' WHEN 6 THEN concat('we set x = ', p_size, ' and y = 2 here') WHEN 7 THEN concat('see Table ', p_size, ', Fig. ', p_size, ' and Eq. (', p_size, ') in the references') ELSE p_name END"


@_query(f"""
WITH e AS (SELECT p_partkey, lower({_ELEMENT}) AS raw, {_TEXT} AS text FROM part), f AS (SELECT *, {_FLAT('text')} AS low, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM e)
SELECT p_partkey, CASE WHEN raw IN ('table', 'document_table') THEN 'table' WHEN raw IN ('picture', 'image', 'figure') THEN 'figure' WHEN raw IN ('formula', 'equation') THEN 'equation' WHEN raw = 'code' AND regexp_matches(trim(text), '(?i)^algorithm\\s*[A-Za-z0-9]') THEN 'algorithm' WHEN length(trim(text)) <= 64 AND regexp_matches(trim(text), '{R.HEADING}') THEN 'section_header' ELSE 'paragraph' END AS record_type,
  low IN ({', '.join(repr(p) for p in R.PLACEHOLDERS)}) OR {' OR '.join(f"contains(low, '{m}')" for m in R.INSTRUCTIONS)} AS placeholder, length(flat) BETWEEN 16 AND 2200 AND regexp_matches(flat, '{R.MATH}') AS math FROM f""")
def element_types(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ELEMENT).alias("raw"), F.expr(_TEXT).alias("text"))
    return rows.select("p_partkey", R.record_type(F.col("raw"), F.col("text"))["record_type"].alias("record_type"), R.is_placeholder(F.col("text")).alias("placeholder"), R.is_math_text(F.col("text")).alias("math"))


_H = lambda word, p: f"'{word}' || nullif(regexp_extract(text, '{p}', 1), '')"


@_query(f"""
WITH e AS (SELECT p_partkey, {_TEXT} AS text FROM part), h AS (SELECT p_partkey, 1 AS k, 'table' AS t, coalesce({_H('Table ', '(?i)\\b(?:table|tab\\.)\\s*(\\d+[A-Za-z]?)')}, CASE WHEN len(regexp_extract_all(text, '\\|')) >= 4 THEN '' END) AS l FROM e
UNION ALL SELECT p_partkey, 2, 'figure', {_H('Figure ', '(?i)\\b(?:figure|fig\\.)\\s*(\\d+[A-Za-z]?)')} FROM e
UNION ALL SELECT p_partkey, 3, 'equation_algorithm', coalesce({_H('Algorithm ', '(?i)\\balgorithm\\s*(\\d+)')}, {_H('Equation ', '(?i)\\b(?:equation|eq\\.)\\s*\\(?(\\d+)\\)?')}, CASE WHEN len(regexp_extract_all(text, '[=∑∏∫≤≥]')) >= 2 THEN '' END) FROM e
UNION ALL SELECT p_partkey, 4, 'citation_context', coalesce({_H('', '^\\s*\\[(\\d{{1,4}})\\]')}, CASE WHEN regexp_matches(text, '(?i)\\breferences\\b') THEN '' END) FROM e)
SELECT p_partkey, string_agg(t || ':' || l, ';' ORDER BY k) AS hints FROM h WHERE l IS NOT NULL GROUP BY p_partkey""")
def type_hints(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", R.type_hints(F.expr(_TEXT)).alias("h")).where(F.size("h") > 0)
    return rows.select("p_partkey", F.array_join(F.transform("h", lambda x: F.concat(x["source_type"], F.lit(":"), x["label"])), ";").alias("hints"))


_BOX = ("l_partkey % 1300 - 100", "l_suppkey % 90", "l_orderkey % 1200", "l_quantity * 20")


@_query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({_BOX[0]})::DOUBLE AS x0, ({_BOX[1]})::DOUBLE AS y0, ({_BOX[2]})::DOUBLE AS x1, ({_BOX[3]})::DOUBLE AS y1 FROM lineitem),
c AS (SELECT *, greatest(0e0, least(1000e0, least(x0, x1))) AS a, greatest(0e0, least(1000e0, least(y0, y1))) AS b, greatest(0e0, least(1000e0, greatest(x0, x1))) AS c, greatest(0e0, least(1000e0, greatest(y0, y1))) AS d FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN a < c AND b < d THEN round(a)::INT || ',' || round(b)::INT || ',' || round(c)::INT || ',' || round(d)::INT END AS box, CASE WHEN a < c AND b < d THEN a <> x0 OR b <> y0 OR c <> x1 OR d <> y1 END AS repaired FROM c""")
def box_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.repair_box(*[F.expr(b).cast("double") for b in _BOX]).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("b").isNotNull(), F.concat_ws(",", "b.x0", "b.y0", "b.x1", "b.y1")).alias("box"), F.col("b.repaired").alias("repaired"))


@_query()
def pipe_table_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("|")).select("doc_id", B.pipe_table("text").alias("t")).where("t.columns is not null")
    return rows.select("doc_id", F.size("t.columns").alias("n_columns"), F.size("t.rows").alias("n_rows"))


@_query("""
WITH c AS (SELECT l_orderkey AS k, l_linenumber % 3 AS r0, l_linenumber % 3 + 1 + l_suppkey % 2 AS r1, l_partkey % 4 AS c0, l_partkey % 4 + 1 + l_suppkey % 2 AS c1, l_returnflag AS text, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS line FROM lineitem),
p AS (SELECT k, r.r AS row, q.q AS col, text, line FROM c, range(0, 6) r(r), range(0, 8) q(q) WHERE r.r >= r0 AND r.r < r1 AND q.q >= c0 AND q.q < c1)
SELECT k, row::INT AS row, col::INT AS "column", max_by(text, line) AS text FROM p GROUP BY ALL""")
def span_grid(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    n = lambda e: F.expr(e).cast("int")
    cells = l.select(F.col("l_orderkey").alias("k"), n("l_linenumber % 3").alias("row0"), n("l_linenumber % 3 + 1 + l_suppkey % 2").alias("row1"), n("l_partkey % 4").alias("col0"), n("l_partkey % 4 + 1 + l_suppkey % 2").alias("col1"), F.col("l_returnflag").alias("text"), F.lit(False).alias("header"), F.expr("l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey").alias("line"))
    return B.span_grid(cells, "k").drop("header")


@_query("""
WITH k AS (SELECT DISTINCT p_size AS s, p_brand || '@' || (p_partkey % 3) AS key FROM part), n AS (SELECT DISTINCT p_size AS s, lower(p_brand) || '_at_' || (p_partkey % 5) AS name FROM part),
p AS (SELECT s, key, name, CASE WHEN regexp_replace(lower(key), '[^a-z0-9]+', '', 'g') = regexp_replace(name, '[^a-z0-9]+', '', 'g') THEN 1000000 ELSE len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(key), '[a-z0-9]+'), lambda w: length(w) >= 2)), list_distinct(list_filter(regexp_extract_all(name, '[a-z0-9]+'), lambda w: length(w) >= 2)))) END AS score FROM k JOIN n USING (s)),
b AS (SELECT *, max(score) OVER (PARTITION BY s, key) AS best FROM p), t AS (SELECT s, key, count(*) AS n, min(name) AS name FROM b WHERE score = best AND best > 0 GROUP BY s, key)
SELECT s, key, name FROM t WHERE n = 1""")
def schema_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    keys = p.select(F.col("p_size").alias("s"), F.concat("p_brand", F.lit("@"), F.col("p_partkey") % 3).alias("key"))
    names = p.select(F.col("p_size").alias("s"), F.concat(F.lower("p_brand"), F.lit("_at_"), F.col("p_partkey") % 5).alias("name"))
    return B.match_columns(keys, names, "s")


@_query(f"""
WITH {SQL_LABELS}, {SQL_QUESTIONS}, e AS (SELECT record_id % 100 AS claim_id, record_id AS triple_id, {_FLAT('label')} AS s, kind AS o FROM labelled), u AS (SELECT claim_id, triple_id, s AS entity FROM e UNION SELECT claim_id, triple_id, o FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, entity ORDER BY triple_id) AS rn FROM u WHERE entity <> '') SELECT claim_id, entity, string_agg(triple_id::VARCHAR, ',' ORDER BY triple_id) AS triples FROM r WHERE rn <= 4 GROUP BY ALL""")
def triple_navigation(spark, sf_dir):
    rows = labelled(spark, sf_dir).select((F.col("record_id") % 100).alias("claim_id"), F.col("record_id").alias("triple_id"), F.col("label").alias("subject"), F.col("kind").alias("object"))
    return G.triple_graph(rows).select("claim_id", "entity", F.array_join(F.transform("triples", lambda t: t.cast("string")), ",").alias("triples"))


@_query()
def structured_choice(spark, sf_dir):
    scored = option_support(spark, sf_dir).select(F.col("c_custkey").alias("query_id"), F.col("opt").alias("key"), "support")
    asked = questions(spark, sf_dir).select("query_id")
    return G.choice_by_support(scored, "query_id").join(asked, "query_id")
