"""Queries of counted answers, prompt audits, gold matched through hints, and evidence packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A, counting as N, matching as M, packages as P
from ..session import dealt_by_size, staged, table
from .fixtures import SQL_LINES, lines

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- counted answers: a question for every order, its lines as catalog

_ASKED = "CASE o_custkey % 5 WHEN 0 THEN concat('How many parentheses are in Equation ', o_custkey % 3, '?') WHEN 1 THEN 'What is the index of the last reference?' WHEN 2 THEN 'How many references include Smith as an author?' WHEN 3 THEN 'How many papers are cited in the Method section?' ELSE 'What else?' END"
_KIND = "CASE o_custkey % 5 WHEN 0 THEN 'equation_algorithm' WHEN 3 THEN 'text_span' ELSE 'citation_context' END"
_SHOWN = """CASE o_custkey % 5 WHEN 0 THEN CASE l_partkey % 4 WHEN 0 THEN 'g(a) = f(x) (3)' WHEN 1 THEN 'f(x)' WHEN 2 THEN 'a = ( was not emitted' ELSE 'b = ((c))' END
 WHEN 3 THEN CASE l_partkey % 3 WHEN 0 THEN 'as (Lee et al., 2020; Kim, 2019a; Kim, 2019) and (Lee et al., 2020)' WHEN 1 THEN concat('no work (Ng, ', 2000 + l_suppkey % 20, ')') ELSE 'none (2020)' END
 ELSE CASE l_partkey % 4 WHEN 0 THEN 'Guidelines: 2020' WHEN 1 THEN 'Jones, K. without a year' ELSE 'Smith, J., a paper, 2020.' END END"""
_CID = "CASE WHEN l_partkey % 9 = 0 THEN 'x' WHEN l_partkey % 2 = 0 THEN concat('#', l_linenumber) ELSE concat(l_linenumber, '') END"
_SECTION = "CASE WHEN l_suppkey % 2 = 0 THEN 'Our Methods' ELSE 'Intro' END"


@_query(rf"""
WITH {SQL_LINES}, c AS (SELECT l_orderkey AS query_id, l_linenumber AS pos, 'E' || l_linenumber AS ref, o_custkey % 5 AS rule, o_custkey % 3 AS eq, l_suppkey % 3 AS label, {_SHOWN} AS text, {_CID} AS cid, {_SECTION} AS section FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0 OR l_suppkey % 2 = 1),
a AS (SELECT query_id, 'parentheses' AS rule, (length(text) - length(replace(text, '(', '')) - regexp_matches(text, '\(\d+\)$')::INT)::BIGINT AS value, [ref] AS refs FROM c WHERE rule = 0 AND label = eq AND NOT contains(text, 'not emitted') AND contains(text, '=') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) = 1),
g AS (SELECT * FROM c WHERE rule IN (1, 2) AND text NOT LIKE 'Guidelines%'), i AS (SELECT query_id, ref, try_cast(replace(cid, '#', '') AS BIGINT) AS n FROM g WHERE rule = 1),
b AS (SELECT query_id, 'last_reference' AS rule, max(n) AS value, [arg_max(ref, n)] AS refs FROM i WHERE n IS NOT NULL GROUP BY query_id HAVING max(n) = count(DISTINCT n) AND max(n) = count(*)),
d AS (SELECT query_id, 'author' AS rule, count(*) AS value, list(ref ORDER BY pos) AS refs FROM g WHERE rule = 2 AND text LIKE 'Smith%' GROUP BY query_id),
w AS (SELECT query_id, pos, ref, unnest(CASE WHEN text LIKE 'as%' THEN ['Lee et al. 2020', 'Kim 2019'] WHEN text LIKE 'no w%' THEN [text] ELSE [NULL] END) AS work FROM c WHERE rule = 3 AND section = 'Our Methods'),
e AS (SELECT query_id, 'cited_works' AS rule, count(DISTINCT work) AS value, list(DISTINCT ref ORDER BY ref) AS refs FROM w GROUP BY query_id HAVING count(work) > 0)
SELECT query_id, rule, value, array_to_string(refs, ',') AS refs FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e)""")
def evidence_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    questions = o.select(F.col("o_orderkey").alias("query_id"), F.expr(_ASKED).alias("question"), F.when(F.col("o_custkey") % 2 == 1, F.array(F.lit("1"))).alias("papers"))
    rows = lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    catalog = rows.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("at"), F.concat(F.lit("E"), "l_linenumber").alias("ref"), (F.col("l_suppkey") % 2).alias("paper_id"), F.expr(_KIND).alias("source_type"),
        F.concat(F.lit("Equation "), F.col("l_suppkey") % 3).alias("label"), F.expr(_SHOWN).alias("text"), F.expr(_CID).alias("citation_id"), F.expr(_SECTION).alias("section_title"), F.lit(None).cast("string").alias("section_id"),
    )
    return N.counts(questions, catalog).withColumn("refs", F.array_join("refs", ","))


# --- prompt audits: an order's lines as selected records and as packets, differing where parts and suppliers say so


@_query(f"""
WITH {SQL_LINES}, s AS (SELECT l_orderkey AS q, 'E' || l_linenumber AS ref, l_partkey, l_suppkey, l_linenumber AS n FROM lines),
f AS (SELECT q, ref, 'not in packets' AS problem FROM s WHERE l_partkey % 11 = 0 UNION ALL SELECT q, 'X' || n, 'not selected' FROM s WHERE l_partkey % 13 = 0
  UNION ALL SELECT q, ref, 'field text' FROM s WHERE l_partkey % 11 <> 0 AND l_suppkey % 17 = 0 UNION ALL SELECT q, ref, 'field page' FROM s WHERE l_partkey % 11 <> 0 AND l_suppkey % 19 = 0 UNION ALL SELECT q, ref, 'field label' FROM s WHERE l_partkey % 11 <> 0 AND l_suppkey % 23 = 0
  UNION ALL SELECT q, 'I' || n, 'image not attached' FROM s WHERE n = 2 AND l_partkey % 7 = 0 UNION ALL SELECT q, 'I' || n, 'image missing' FROM s WHERE n = 2 AND l_partkey % 7 = 1 UNION ALL SELECT q, 'I' || n, 'image not declared' FROM s WHERE n = 3 AND l_partkey % 7 = 2)
SELECT q AS query_id, ref, problem FROM f""")
def context_audit(spark, sf_dir):
    rows, n = lines(spark, sf_dir), F.col("l_linenumber")
    base = {f: F.lit(None).cast("string") for f in A.FIELDS} | {"paper_id": F.col("l_suppkey"), "page": n, "label": F.when(F.col("l_partkey") % 2 == 0, F.col("l_mode")), "text": F.col("l_mode"), "locator": F.struct(n.alias("page"), F.col("l_mode").alias("table_id"))}
    head = [F.col("l_orderkey").alias("query_id"), F.concat(F.lit("E"), n).alias("evidence_ref")]
    selected = rows.select(*head, *[c.alias(f) for f, c in base.items()], F.when(n == 2, F.lit("I2")).alias("image_ref"))
    other = base | {"text": F.when(F.col("l_suppkey") % 17 == 0, F.lit("other")).otherwise(F.col("l_mode")), "page": F.when(F.col("l_suppkey") % 19 != 0, n), "label": F.when(F.col("l_suppkey") % 23 == 0, F.lit("other")).otherwise(base["label"])}
    packets = rows.where("l_partkey % 11 <> 0").select(*head, *[c.alias(f) for f, c in other.items()])
    packets = packets.unionByName(rows.where("l_partkey % 13 = 0").select(head[0], F.concat(F.lit("X"), n).alias("evidence_ref"), *[c.alias(f) for f, c in other.items()]))
    images = rows.where("l_linenumber = 2 AND l_partkey % 7 <> 0 OR l_linenumber = 3 AND l_partkey % 7 = 2").select(head[0], F.concat(F.lit("I"), n).alias("image_ref"), (F.col("l_partkey") % 7 != 1).alias("exists"))
    return A.audit_findings(selected, packets, images)


# --- gold evidence that only a hint in prose matches

_PROSE = "CASE WHEN p_size % 3 = 0 THEN concat('see Table ', p_size % 5) WHEN p_size % 3 = 1 THEN concat('in Figure ', p_size % 5, ' and Table ', p_size % 4) ELSE p_name END"


@_query(rf"""
WITH g AS (SELECT p_partkey AS gold_id, p_partkey % 30 AS paper, p_partkey % 4 AS page, CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'figure' END AS gk, CASE WHEN p_size % 2 = 0 THEN 'table ' ELSE 'figure ' END || (p_size % 5) AS gl FROM part),
p AS (SELECT p_partkey AS id, p_partkey % 30 AS paper, p_partkey % 4 AS page, p_size, CASE WHEN p_size % 4 = 0 THEN 'table' ELSE 'text_span' END AS kind, CASE WHEN p_size % 4 = 0 THEN 'table ' || (p_size % 7) ELSE '' END AS label, {_PROSE} AS text FROM part),
h AS (SELECT p.*, 'table' AS hk, 'table ' || regexp_extract(text, 'Table (\d+)', 1) AS hl, 1 AS hint FROM p WHERE contains(text, 'Table') AND kind <> 'table' UNION ALL SELECT p.*, 'figure', 'figure ' || regexp_extract(text, 'Figure (\d+)', 1), 2 FROM p WHERE contains(text, 'Figure')),
r AS (SELECT id::VARCHAR AS record_id, paper, page, id AS pos, 0 AS hint, kind AS rk, label AS rl, 'record' AS origin FROM p UNION ALL SELECT id || '__hint_' || hk, paper, page, id, hint, hk, hl, 'hint of ' || id FROM h),
j AS (SELECT g.*, r.record_id, r.pos, r.hint, r.rk, r.origin, CASE WHEN record_id IS NULL THEN 0 WHEN gk = rk AND gl = rl THEN 4 WHEN gk = rk THEN 2 ELSE 1 END AS level FROM g LEFT JOIN r ON g.paper = r.paper AND g.page = r.page),
k AS (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY level DESC, (hint > 0), pos, hint, record_id) AS rn, (min(CASE WHEN gk = rk THEN struct_pack(v := (hint > 0)::INT, p := pos, h := hint, id := record_id) END) OVER (PARTITION BY gold_id)).id AS relaxed_id FROM j)
SELECT gold_id, ['none', 'page', 'source_type', 'text_overlap', 'locator'][level + 1] AS level, CASE WHEN level = 4 THEN record_id END AS record_id, relaxed_id, CASE WHEN level = 4 THEN origin END AS origin FROM k WHERE rn = 1""")
def hinted_gold(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    place, size = [(F.col("p_partkey") % 30).alias("paper_id"), (F.col("p_partkey") % 4).alias("page")], F.col("p_size")
    gold = p.select(F.col("p_partkey").alias("gold_id"), *place, F.when(size % 2 == 0, "table").otherwise("figure").alias("kind"), F.concat(F.when(size % 2 == 0, "Table ").otherwise("Figure "), size % 5).alias("label"), F.lit("").alias("text"))
    records = p.select(F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("at"), *place, F.when(size % 4 == 0, "table").otherwise("text_span").alias("kind"), F.when(size % 4 == 0, F.concat(F.lit("Table "), size % 7)).otherwise("").alias("label"), F.expr(_PROSE).alias("text"))
    return M.match_gold_with_hints(gold, records)


# --- packages: a question for every supplier, its lines as packages


def _packages(spark, sf_dir):
    rows = lines(spark, sf_dir).join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey"))  # parts grow with lines: none is broadcast
    rows = dealt_by_size(rows, table(spark, sf_dir, "lineitem").count(), 50_000, "l_suppkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("text_span", "table", "figure", "equation_algorithm", "citation_context")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    at = F.row_number().over(P.W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")).cast("long")
    return rows.select(
        F.col("l_suppkey").alias("query_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("package_id"), at.alias("at"), (F.col("l_orderkey") % 9).alias("paper_id"), F.col("l_linenumber").alias("page"), kind.alias("kind"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("Table "), F.col("l_partkey") % 40)).alias("label"), F.when(F.col("l_partkey") % 3 == 0, "method").alias("section_type"), F.lit(None).cast("string").alias("section_title"), F.array("p_brand").alias("columns"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand", "l_mode").alias("text"), F.round(F.col("l_quantity") / 50, 2).alias("score"), F.when(F.col("l_partkey") % 4 == 0, F.col("p_retailprice")).alias("visual"),
    )


@_query()
def selected_packages(spark, sf_dir):
    """Whole selections, slots and reasons; against a plain loop in the tests."""
    s = table(spark, sf_dir, "supplier")
    key, name = F.col("s_suppkey").alias("query_id"), F.col("s_suppkey")
    none = F.lit(None).cast("string")
    questions = s.select(key, F.concat(F.lit("What does Table "), name % 40, F.lit(" say of the cold widget method?")).alias("question"), none.alias("hint"), F.when(name % 2 == 0, F.array(F.lit("figure"))).alias("kinds"), (name % 3 == 0).alias("several"))
    ways = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.lit(i).alias("route"), F.lit(t).alias("text"), F.array(*[F.lit(k) for k in kinds]).cast("array<string>").alias("kinds"), F.lit(paper).cast("string").alias("paper_id")) for i, (w, t, kinds, paper) in enumerate((("claim", "small widget", (), None), ("slot", "Brand 5 economy", ("table",), None), ("slot", "rail", ("equation_algorithm", "citation_context"), None), ("fallback_slot", "standard", (), None), ("slot_paper", "brand accuracy Brand-13", ("table",), "3"), ("paper_local", "ship", (), "5")))])).alias("w")
    routes = s.select(key, ways).select("query_id", "w.*")
    return P.select_packages(questions, _packages(spark, sf_dir), routes, P.PackageOptions(papers=3))


@_query(f"""
WITH {SQL_LINES}, r AS (SELECT l_orderkey AS paper, l_linenumber AS n, l_orderkey || '-' || l_linenumber AS id, CASE l_partkey % 3 WHEN 0 THEN 'text_span' WHEN 1 THEN 'table' ELSE 'figure' END AS kind, CASE l_partkey % 3 WHEN 1 THEN 'Table ' || (l_suppkey % 3) WHEN 2 THEN 'Figure ' || (l_suppkey % 3) END AS label, l_partkey % 3 AS k, l_suppkey % 3 AS x, l_suppkey % 2 AS w FROM lines),
o AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY n) AS i FROM r),
near AS (SELECT a.id AS a, b.id AS b, a.kind FROM o a JOIN o b ON a.paper = b.paper AND abs(a.i - b.i) <= 1 AND (a.k = 0 OR b.k = 0)),
told AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON a.paper = b.paper AND a.k > 0 AND b.k = 0 AND b.w = a.k % 2 AND a.x = b.x QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(a.n - b.n), b.n) <= 2),
m AS (SELECT a, b FROM near WHERE kind = 'text_span' UNION SELECT a, b FROM near WHERE a NOT IN (SELECT a FROM told) UNION SELECT * FROM told UNION SELECT a.id, b.id FROM o a JOIN o b ON a.paper = b.paper AND a.kind = b.kind AND a.label = b.label UNION SELECT id, id FROM r)
SELECT a AS anchor_id, b AS record_id, row_number() OVER (PARTITION BY a ORDER BY r.n) AS place FROM m JOIN r ON r.id = m.b""")
def package_members(spark, sf_dir):
    rows, k, x = lines(spark, sf_dir), F.col("l_partkey") % 3, F.col("l_suppkey") % 3
    named = F.when(F.col("l_suppkey") % 2 == 1, F.concat(F.lit("as in Tab. "), x)).otherwise(F.concat(F.lit("as in Fig. "), x))
    kind = F.when(k == 0, "paragraph").when(k == 1, "table").otherwise("figure")
    records = rows.select(F.col("l_orderkey").cast("string").alias("paper_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), F.lit(1).cast("long").alias("page"), F.col("l_linenumber").cast("long").alias("reading"), kind.alias("record_type"), F.lit(None).cast("string").alias("source_type"), F.lit("s").alias("section_id"), F.when(k == 1, F.concat(F.lit("Table "), x)).when(k == 2, F.concat(F.lit("Figure "), x)).alias("label"), F.when(k == 0, named).otherwise("").alias("text"))
    rows = staged(P.canonical(records), "records")
    return P.package_records(rows, rows, 1)
