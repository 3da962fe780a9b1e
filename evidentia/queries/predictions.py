"""Queries of normalised and grounded predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grounding as G, hierarchy as H, predictions as P
from ..session import staged, table
from .fixtures import SQL_LINES, lines

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TYPE = "CASE {0} % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'citation_context' ELSE 'text_span' END"
_OVERLAP = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE END"
_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) > 2))"


def selected(spark, sf_dir):
    """Every line of an order as a selected record; two lines in three have a hint for another type."""
    rows = lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    hint = F.struct(F.expr(_TYPE.format("l_suppkey")).alias("source_type"), (F.col("l_suppkey") % 9 + 1).alias("page"), F.concat(F.lit("Table "), F.col("l_suppkey") % 6).alias("label"))
    return rows.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("place"), (F.col("l_suppkey") % 4).alias("paper_id"), F.expr(_TYPE.format("l_partkey")).alias("source_type"), (F.col("l_partkey") % 7 + 1).alias("page"),
        F.concat_ws(" ", "l_mode", "o_orderpriority").alias("text"), F.concat(F.lit("Table "), F.col("l_partkey") % 5).alias("label"), F.when(F.col("l_suppkey") % 3 < 2, F.array(hint)).otherwise(F.array().cast("array<struct<source_type:string,page:bigint,label:string>>")).alias("hints"),
    )


def items(spark, sf_dir):
    """Predicted evidence: one for every order, some without a paper, a type or a page."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("query_id"), F.lit(1).cast("long").alias("at"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 4).alias("paper_id"), F.when(F.col("o_custkey") % 5 > 0, F.expr(_TYPE.format("o_custkey"))).alias("source_type"), F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey") % 7 + 1).alias("page"),
        F.concat_ws(" ", "o_orderpriority", F.lit("AIR RAIL collect")).alias("text"), F.when(F.col("o_custkey") % 2 == 0, F.array((F.col("o_custkey") % 2).cast("long"), F.lit(3).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("papers"), F.array(F.lit("table"), F.lit("figure")).alias("preferred"), F.concat(F.lit("Table "), F.col("o_custkey") % 5).alias("label"),
    )


_SQL_SELECTED = f"""{SQL_LINES}, s AS (SELECT l_orderkey AS query_id, l_linenumber AS place, l_suppkey % 4 AS paper, {_TYPE.format('l_partkey')} AS kind, l_partkey % 7 + 1 AS page, concat_ws(' ', l_mode, o_orderpriority) AS text, CASE WHEN l_suppkey % 3 < 2 THEN {_TYPE.format('l_suppkey')} END AS hint FROM lines JOIN orders ON l_orderkey = o_orderkey)"""
_SQL_ITEMS = f"""i AS (SELECT o_orderkey AS query_id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 4 END AS ipaper, CASE WHEN o_custkey % 5 > 0 THEN {_TYPE.format('o_custkey')} END AS ikind, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 7 + 1 END AS ipage, o_orderpriority || ' AIR RAIL collect' AS itext, CASE WHEN o_custkey % 2 = 0 THEN [o_custkey % 2, 3] ELSE [] END AS papers FROM orders)"""


@_query(f"""
WITH {_SQL_SELECTED}, {_SQL_ITEMS}, j AS (SELECT i.*, s.* EXCLUDE (query_id), {_TOKENS.format('itext')} AS a, {_TOKENS.format('text')} AS b FROM i JOIN s USING (query_id) WHERE CASE WHEN ipaper IS NOT NULL THEN paper = ipaper WHEN len(papers) > 0 THEN list_contains(papers, paper) ELSE true END),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS k FROM j),
c AS (SELECT query_id, place, round({_OVERLAP} + CASE WHEN kind IN ('table', 'figure') THEN 1.2e0 ELSE 0e0 END + CASE WHEN hint IN ('table', 'figure') THEN 0.9e0 ELSE 0e0 END + CASE WHEN kind = ikind THEN 1e0 ELSE 0e0 END + CASE WHEN hint = ikind THEN 0.8e0 ELSE 0e0 END + CASE WHEN page = ipage THEN 0.7e0 ELSE 0e0 END + CASE WHEN paper = ipaper THEN 0.5e0 ELSE 0e0 END - k * 0.001e0, 6) AS score FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rn FROM c) SELECT query_id, 1 AS at, place, score FROM r WHERE rn = 1""")
def best_evidence(spark, sf_dir):
    return P.best_evidence(items(spark, sf_dir), selected(spark, sf_dir))


@_query()
def standard_evidence(spark, sf_dir):
    return P.standard_evidence(items(spark, sf_dir), staged(selected(spark, sf_dir), "selected"))


@_query("""
WITH c AS (SELECT o_custkey AS query_id, o_orderkey % 10 AS paper_id, min(o_orderkey) AS rank FROM orders GROUP BY ALL), t AS (SELECT query_id, arg_min(paper_id, rank) AS top FROM c GROUP BY query_id),
p AS (SELECT l_suppkey AS query_id, l_partkey % 15 AS paper_id, min(l_orderkey * 100 + l_partkey % 15) AS pos FROM lineitem GROUP BY ALL), m AS (SELECT p.query_id, p.pos, c.paper_id IS NOT NULL AS known, coalesce(c.paper_id, top) AS paper_id FROM p LEFT JOIN c USING (query_id, paper_id) LEFT JOIN t ON t.query_id = p.query_id),
o AS (SELECT query_id, paper_id, arg_min(known, pos) AS known, min(pos) AS pos FROM m WHERE paper_id IS NOT NULL GROUP BY ALL), a AS (SELECT query_id, paper_id, pos, CASE WHEN known THEN '' ELSE 'noncandidate_paper_id' END AS audit FROM o UNION ALL SELECT query_id, top, 0, 'fallback_paper_id' FROM t WHERE query_id NOT IN (SELECT query_id FROM o))
SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place, audit FROM a""")
def candidate_papers(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 10).alias("paper_id")).agg(F.min("o_orderkey").alias("rank"))
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 15).alias("paper_id")).agg(F.min(F.col("l_orderkey") * 100 + F.col("l_partkey") % 15).alias("at"))
    return P.candidate_papers(p, c)


@_query("""
WITH r AS (SELECT o_custkey AS query_id, printf('E%04d', o_orderkey % 40) AS evidence_ref, min(o_orderkey) AS pos FROM orders GROUP BY ALL), c AS (SELECT DISTINCT o_custkey AS query_id, printf('E%04d', o_orderkey % 20) AS evidence_ref, 'P' || (o_orderkey % 20) AS paper_id, 'table' AS source_type, o_orderkey % 20 AS page, 'Table 1' AS label FROM orders)
SELECT r.query_id, evidence_ref, paper_id, source_type, page, label, paper_id IS NOT NULL AS known, row_number() OVER (PARTITION BY r.query_id ORDER BY pos, evidence_ref) AS place FROM r LEFT JOIN c USING (query_id, evidence_ref)""")
def evidence_echo(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    refs = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("at"), F.format_string("E%04d", F.col("o_orderkey") % 40).alias("evidence_ref"))
    n = F.col("o_orderkey") % 20
    held = o.select(F.col("o_custkey").alias("query_id"), F.format_string("E%04d", n).alias("evidence_ref"), F.concat(F.lit("P"), n).alias("paper_id"), F.lit("table").alias("source_type"), n.alias("page"), F.lit("Table 1").alias("label")).distinct()
    return P.echoed_evidence(refs, held)


@_query("SELECT o_orderkey AS query_id, o_custkey AS paper_id, o_orderpriority AS kind, [o_custkey % 3, 1] AS pages, 3 AS fields FROM orders")
def public_predictions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.col("o_custkey").alias("paper_id"), F.lit("r1").alias("record_id"), F.struct(F.lit(1).alias("bbox_1000"), F.col("o_orderpriority").alias("kind"), F.array(F.struct((F.col("o_custkey") % 3).alias("page"), F.lit("x").alias("label")), F.struct(F.lit(1).alias("page"), F.lit("y").alias("label"))).alias("pages")).alias("locator"))
    rows = P.public(o.select(F.col("o_orderkey").alias("query_id"), F.array(item).alias("evidence"), F.lit(0.5).alias("confidence"), F.lit("n").alias("notes"), F.struct(F.lit("t").alias("text")).alias("answer")))
    held = F.col("evidence")[0]
    assert rows.schema["evidence"].dataType.elementType.fieldNames() == ["paper_id", "locator"]
    return rows.select("query_id", held["paper_id"].alias("paper_id"), held["locator"]["kind"].alias("kind"), held["locator"]["pages"]["page"].alias("pages"), F.lit(len(rows.columns)).alias("fields"))


_FLAT = "trim(regexp_replace(replace(replace(replace(lower({0}), '−', '-'), '–', '-'), '—', '-'), '\\s+', ' ', 'g'))"


@_query("""
WITH v AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'about ' || o_custkey WHEN 2 THEN 'by nobody' ELSE 'Clerk ' || o_custkey END AS value, o_orderkey % 4 AS k, o_orderkey % 10 AS h FROM orders WHERE o_orderkey % 9 > 0)
SELECT query_id, 'answer' AS field, CASE WHEN k = 2 AND h > 4 THEN '' ELSE value END AS value, CASE WHEN h = 1 THEN 'visual_slot_grounded' WHEN h = 2 THEN 'derived_value_grounded' WHEN h IN (3, 4) THEN 'slot_supported_grounded' WHEN h = 0 AND k = 2 THEN 'unsupported_value_removed' WHEN k = 2 AND h > 4 THEN 'unsupported_value_removed' ELSE 'directly_grounded' END AS status
FROM (SELECT query_id, k, h, CASE WHEN k = 2 AND h = 0 THEN '' ELSE value END AS value FROM v)""")
def fact_gate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("about "), "o_custkey")).when(F.col("o_orderkey") % 4 == 2, "by nobody").otherwise(F.concat(F.lit("Clerk "), "o_custkey"))
    rows = o.select(F.col("o_orderkey").alias("query_id"), F.lit("answer").alias("field"), F.when(F.col("o_orderkey") % 9 > 0, value).alias("value"))
    evidence = o.select(F.col("o_orderkey").alias("query_id"), F.concat_ws("  ", "o_orderpriority", "o_custkey").alias("text")).unionByName(o.select(F.col("o_orderkey").alias("query_id"), F.upper(F.concat(F.lit("Clerk "), "o_custkey")).alias("text")))
    h = F.col("o_orderkey") % 10
    verified = o.select(F.col("o_orderkey").alias("query_id"), F.upper(value).alias("value"), F.when(h == 1, "visual").when(h == 2, "derived").when(h.isin(3, 4), "slot").alias("how")).where("how is not null")
    return P.fact_gate(rows, evidence, verified)


@_query(f"""
WITH {SQL_LINES}, q AS (SELECT DISTINCT l_orderkey AS query_id, l_orderkey % 2 = 0 AS explicit FROM lines), c AS (SELECT l_orderkey AS query_id, l_linenumber AS n, l_linenumber % 2 = 0 AS tab, l_mode, l_suppkey, l_quantity FROM lines),
g AS (SELECT c.*, explicit AND tab AND NOT contains(lower(l_mode), 'air') AS gone FROM c JOIN q USING (query_id)),
p AS (SELECT g.*, n <= 3 AND NOT gone AS claimed, n BETWEEN 2 AND 4 AS planned FROM g), r AS (SELECT *, planned AND claimed AND (n <> 3) AS accepted FROM p)
SELECT query_id, list_sort(list(printf('E%04d', n)) FILTER (WHERE claimed)) AS evidence_refs, list_sort(list_distinct(list(l_suppkey) FILTER (WHERE claimed AND l_suppkey % 3 > 0))) AS papers, count(*) FILTER (WHERE accepted) AS rows FROM r GROUP BY query_id HAVING count(*) FILTER (WHERE l_suppkey % 3 > 0) > 0""")
def grounded_predictions(spark, sf_dir):
    l = lines(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), "l_linenumber", "l_suppkey", "l_mode", "l_quantity")
    l = staged(l, "lines")
    ref, key, n = F.format_string("E%04d", "l_linenumber").alias("evidence_ref"), F.format_string("C%03d", "l_linenumber").alias("card_key"), F.col("l_linenumber")
    held = l.select("query_id", ref, F.col("l_suppkey").alias("paper_id"), F.lit(1).alias("record_id"), F.concat(F.lit("costs "), F.col("l_quantity").cast("int")).alias("text"))
    cards = l.select("query_id", key, ref, F.when(n % 2 == 0, "table").otherwise("figure").alias("source_type"), F.concat(F.lit("by "), "l_mode").alias("proposition"))
    claims = l.where("l_linenumber <= 3").groupBy("query_id").agg(F.collect_list(key).alias("keys"))
    claims = claims.select("query_id", F.lit("Q01").alias("claim_id"), F.when(F.col("query_id") % 2 == 0, "explicitly mention AIR").otherwise("mentions AIR").alias("claim"), F.concat("keys", F.array(F.lit("C999"))).alias("keys"), F.lit("table").alias("primary"))
    linked = staged(P.grounded_claims(claims, cards, held), "linked")
    plan = l.where("l_linenumber between 2 and 4").select("query_id", n.alias("row"), key, F.lit("Cost").alias("column"), F.when(n == 3, "no such value").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value"))
    plan = plan.unionByName(l.where("l_linenumber between 2 and 4").select("query_id", n.alias("row"), key, F.lit("Paper Title").alias("column"), F.col("l_suppkey").cast("string").alias("value")))
    papers = l.where("l_suppkey % 3 > 0").select("query_id", F.col("l_suppkey").alias("paper_id")).distinct()
    return P.grounded_predictions(papers, linked, P.grounded_rows(plan, linked, held), held)


@_query(f"""
WITH {SQL_LINES}, c AS (SELECT l_orderkey AS query_id, l_linenumber AS row, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE l_mode || CASE WHEN l_partkey % 2 = 0 THEN ' (base)' ELSE '' END END AS k, l_quantity::INT || ' ± ' || l_linenumber AS pm, '1,' || printf('%03d', l_partkey % 1000) || ' ms' AS num, l_partkey FROM lines),
n AS (SELECT *, CASE WHEN contains(k, 'AIR') AND contains(k, 'REG') THEN k WHEN contains(k, 'AIR') THEN 'AIR' WHEN contains(k, 'RAIL') THEN 'RAIL' ELSE k END AS named FROM c WHERE trim(k) <> ''),
m AS (SELECT *, CASE WHEN contains(k, 'REG') THEN 'AIR' ELSE named END AS named2, row_number() OVER (PARTITION BY query_id, regexp_replace(lower(CASE WHEN contains(k, 'REG') THEN 'AIR' ELSE named END), '[^a-z0-9]+', '', 'g') ORDER BY row) AS i FROM n), d AS (SELECT *, CASE WHEN named2 <> k THEN 'table_question_alias_row_key_canonicalized' ELSE '' END AS audit FROM m WHERE i = 1)
SELECT query_id, row, 'Mode' AS column, named2 AS value, NULL::DOUBLE AS number, audit FROM d UNION ALL SELECT query_id, row, 'Error', regexp_replace(pm, '\\s*±\\s*', '±', 'g'), NULL, audit FROM d UNION ALL SELECT query_id, row, 'Time', num, 1000e0 + l_partkey % 1000, audit FROM d""")
def table_rows(spark, sf_dir):
    l = lines(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("row"), "l_mode", "l_partkey", "l_quantity")
    key = F.when(F.col("row") % 5 == 0, " ").otherwise(F.concat("l_mode", F.when(F.col("l_partkey") % 2 == 0, " (base)").otherwise("")))
    values = {"Mode": key, "Error": F.concat(F.col("l_quantity").cast("int"), F.lit(" ± "), "row"), "Time": F.concat(F.lit("1,"), F.format_string("%03d", F.col("l_partkey") % 1000), F.lit(" ms")), "Other": F.lit("x")}
    cells = l.select("query_id", "row", F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("column", "value"))
    q = l.select("query_id").distinct()
    schema = q.select("query_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("place"), F.lit(t).alias("kind")) for k, (c, t) in enumerate((("Mode", "string"), ("Error", "string"), ("Time", "number")))])).alias("s")).select("query_id", "s.*")
    return P.table_rows(cells, q.withColumn("aliases", F.array(F.lit("AIR"), F.lit("RAIL"))), schema)


_LABEL = "CASE l_partkey % 4 WHEN 0 THEN 'Table ' || (l_suppkey % 3) WHEN 1 THEN 'Figure ' || (l_suppkey % 3) END"


@_query(f"""
WITH {SQL_LINES}, p AS (SELECT l_orderkey AS query_id, l_suppkey % 4 AS paper_id, {_TYPE.format('l_partkey')} AS kind, l_partkey % 7 + 1 AS page, {_LABEL} AS label, l_linenumber FROM lines),
a AS (SELECT query_id, paper_id, kind, list(page) AS pages, list(label) AS labels FROM p WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT query_id, paper_id, kind, CASE WHEN list_contains(pages, page) THEN page END AS page, CASE WHEN list_contains(labels, label) THEN label END AS label FROM p JOIN a USING (query_id, paper_id, kind)""")
def visible_evidence(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 4).alias("paper_id"), F.expr(_TYPE.format("l_partkey")).alias("kind"), (F.col("l_partkey") % 7 + 1).alias("page"), F.expr(_LABEL).alias("label"), "l_linenumber")
    return H.restrict(rows, H.allowed_locators(rows.where("l_linenumber <= 2")))


@_query(f"WITH {SQL_LINES} SELECT l_orderkey, l_linenumber, l_partkey % 3 = 0 AND l_suppkey % 2 = 0 AS grounded FROM lines")
def card_gate(spark, sf_dir):
    n, k = F.col("l_quantity").cast("int"), F.col("l_partkey") % 3
    said = F.when(F.col("l_suppkey") % 2 == 0, n.cast("string")).otherwise("none")
    claim, record = F.concat(F.lit("NetX gets "), n, F.lit(" on "), "l_mode"), F.concat(F.lit("We see that NetX gets "), said, F.lit(" on "), "l_mode", F.lit(" here."))
    quote = F.when(k == 0, F.concat(F.lit("NetX  gets "), said, F.lit(" on "), "l_mode")).when(k == 1, F.concat(claim, F.lit(" indeed"))).otherwise(F.concat(F.lit("NetX gets "), said))
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", G.grounded(claim, quote, record).alias("grounded"))
