"""Queries of answer contracts, record joins and stop conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contracts as C
from ..session import table
from .fixtures import KIND

QUERIES, SQL = {}, {}

#: JSON texts of options and schemas in every accepted form, by order.
_OPTIONS = """CASE o_orderkey % 5 WHEN 0 THEN concat('{"A": "', o_orderpriority, '", " B ": "', o_orderstatus, '", " ": "x"}')
 WHEN 1 THEN concat('[{"label": "P", "value": "', o_orderpriority, '"}, {"option": "Q"}, {"Z": "zed"}, {"text": "last"}]') WHEN 2 THEN concat(' ["', o_orderpriority, '", "two"]') WHEN 3 THEN '17' END"""
_COLUMNS = """CASE o_orderkey % 6 WHEN 0 THEN '["Model", " ", "F1 "]' WHEN 1 THEN '{"columns": [{"name": "Model"}, {"column": "F1"}, {"key": "N"}]}' WHEN 2 THEN '{"schema": ["Only"]}' WHEN 3 THEN '[]' WHEN 4 THEN 'none' END"""


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query("""
WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, 0 AS place, CASE k WHEN 1 THEN 'P' ELSE 'A' END AS key, p AS text FROM o WHERE k < 3
UNION ALL SELECT o_orderkey, 1, CASE k WHEN 1 THEN 'Q' ELSE 'B' END, CASE k WHEN 0 THEN s WHEN 1 THEN '' ELSE 'two' END FROM o WHERE k < 3
UNION ALL SELECT o_orderkey, 2, 'Z', 'zed' FROM o WHERE k = 1 UNION ALL SELECT o_orderkey, 3, 'text', 'last' FROM o WHERE k = 1""")
def option_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(C.options(F.expr(_OPTIONS))).alias("place", "option"))
    return o.select("o_orderkey", "place", "option.key", "option.text")


@_query("""
WITH i AS (SELECT o_orderkey AS query_id, o_orderkey % 5 AS o, o_orderkey % 6 AS c, o_orderkey % 3 AS v FROM orders)
SELECT query_id, ['table', 'freeform'] AS answer_types, CASE WHEN o = 4 AND v = 0 THEN 1 WHEN o = 0 THEN 2 WHEN o = 1 THEN 4 WHEN o = 2 THEN 2 ELSE 0 END AS n_options, (o < 3 OR (o = 4 AND v = 0)) AS options_available,
  CASE c WHEN 0 THEN 'Model|F1' WHEN 1 THEN 'Model|F1|N' WHEN 2 THEN 'Only' WHEN 5 THEN CASE WHEN v = 0 THEN 'Given' END END AS columns, 0 AS expected_row_count FROM i""")
def answer_contract(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    inputs = o.select(F.col("o_orderkey").alias("query_id"), F.array(F.lit("table"), F.lit("freeform")).alias("answer_types"), F.expr(_OPTIONS).alias("options"), F.expr(_COLUMNS).alias("table_schema"))
    given = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("query_id"), F.lit('["yes"]').alias("options"), F.lit('["Given"]').alias("table_schema"), F.lit("gold").alias("answer"))
    return C.answer_contracts(inputs, given).select("query_id", "answer_types", F.size("options").alias("n_options"), "options_available", F.array_join("table_schema", "|").alias("columns"), "expected_row_count")


@_query(f"""
SELECT p_partkey % 40 AS paper_id, p_size AS page, p_partkey AS record_id, {KIND} AS source_type, CASE WHEN p_partkey % 3 = 0 THEN 'debug' || p_partkey WHEN p_partkey % 4 = 0 THEN 'own' END AS crop_path,
  CASE WHEN p_partkey % 3 = 1 THEN 't' || p_partkey END AS table_crop_path, CASE WHEN p_partkey % 40 < 30 THEN (p_partkey % 40) / 2e0 END AS candidate_score FROM part""")
def crop_enrichment(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    gid = F.concat(F.lit("g"), "p_partkey")
    records = p.select((F.col("p_partkey") % 40).alias("paper_id"), F.col("p_size").alias("page"), F.col("p_partkey").alias("record_id"), gid.alias("global_record_id"), F.expr(KIND).alias("source_type"), F.when(F.col("p_partkey") % 4 == 0, "own").alias("crop_path"))
    debug = p.where("p_partkey % 3 < 2").select(gid.alias("global_record_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("debug"), "p_partkey")).otherwise("").alias("crop_path"), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("t"), "p_partkey")).alias("table_crop_path"))
    scores = spark.range(30).select(F.col("id").alias("paper_id"), (F.col("id") / 2).alias("score"))
    return C.runtime_records(records, debug, scores).drop("global_record_id")


@_query(f"SELECT p_partkey % 40 AS paper_id, p_size AS page, p_partkey AS record_id, {KIND} AS source_type, p_name AS text, count(*) OVER () * 0 + 16 AS fields FROM part")
def runtime_projection(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = C.projected_records(p.select((F.col("p_partkey") % 40).alias("paper_id"), F.col("p_size").alias("page"), F.col("p_partkey").alias("record_id"), F.expr(KIND).alias("source_type"), F.col("p_name").alias("text"), F.lit("x").alias("bbox")))
    return rows.select("paper_id", "page", "record_id", "source_type", "text", F.lit(len(rows.columns)).cast("long").alias("fields"))


@_query("""
SELECT CASE WHEN l_orderkey % 2 = 0 AND l_linenumber % 3 = 0 THEN -l_orderkey ELSE l_orderkey END AS query_id, l_partkey AS paper_id, l_quantity AS score FROM lineitem WHERE l_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1""")
def candidate_rows(spark, sf_dir):
    own = F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_orderkey"))
    entry = F.struct(own.alias("query_id"), F.col("l_partkey").alias("paper_id"), F.col("l_quantity").cast("double").alias("score"))
    nested = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.collect_list(entry).alias("candidates"))
    nested = nested.select("query_id", "candidates", F.lit(None).cast("long").alias("paper_id"), F.lit(None).cast("double").alias("score"))
    flat = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("query_id"), F.lit(None).cast(nested.schema["candidates"].dataType).alias("candidates"), F.col("o_custkey").alias("paper_id"), F.col("o_totalprice").cast("double").alias("score"))
    return C.candidate_entries(nested.unionByName(flat))


@_query("""
WITH n AS (SELECT o_custkey AS paper_id, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'done' END AS status FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey AS paper_id, status, coalesce(n, 0) AS records, n IS NOT NULL AND coalesce(status, '') <> 'failed' AS available FROM customer LEFT JOIN n ON c_custkey = n.paper_id LEFT JOIN s ON c_custkey = s.paper_id""")
def extraction_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"))
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.count("*").alias("n"))
    status = c.where("paper_id % 5 <> 0").withColumn("status", F.when(F.col("paper_id") % 4 == 0, "failed").otherwise("done"))
    return C.extraction_status(c, n, status)


@_query(f"""
WITH r AS (SELECT p_partkey % 900 AS query_id, {KIND} AS kind, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name END AS text FROM part), q AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' ELSE 'text_span' END AS primary_type FROM customer)
SELECT q.query_id, count(text) >= 2 AND coalesce(bool_or(trim(text) <> ''), false) AND (primary_type = 'text_span' OR coalesce(bool_or(kind = primary_type), false)) AS enough FROM q LEFT JOIN r USING (query_id) GROUP BY q.query_id, primary_type""")
def evidence_sufficient(spark, sf_dir):
    r = table(spark, sf_dir, "part").select((F.col("p_partkey") % 900).alias("query_id"), F.expr(KIND).alias("source_type"), F.when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.col("p_name")).alias("text"))
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 3 == 0, "table").when(F.col("c_custkey") % 3 == 1, "figure").otherwise("text_span").alias("primary_type"))
    return C.sufficient(r, q, least=2)


@_query("""
WITH c AS (SELECT c_custkey, c_custkey % 130 AS done, c_custkey % 101 AS total FROM customer), d AS (SELECT *, least(done, total) AS a FROM c)
SELECT c_custkey, CASE WHEN total = 0 THEN '[' || repeat('-', 24) || '] 0/0' ELSE '[' || repeat('#', round_even(24e0 * a / total, 0)::INT) || repeat('-', 24 - round_even(24e0 * a / total, 0)::INT) || '] ' || a || '/' || total || ' ' || printf('%5.1f', 100e0 * a / total) || '%' END AS bar FROM d""")
def progress_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.progress_bar(F.col("c_custkey") % 130, F.col("c_custkey") % 101).alias("bar"))


#: Lines as papers have them: headings, appendices, table rows, prose.
_LINE = """CASE p_partkey % 12 WHEN 0 THEN concat(p_size, '. Introduction') WHEN 1 THEN 'Related  Work' WHEN 2 THEN 'Results.' WHEN 3 THEN concat('Appendix ', substr('ABC', 1 + p_size % 3, 1))
 WHEN 4 THEN concat('B12 ', p_size, ' 3.5/7') WHEN 5 THEN concat('Acc. of ', p_name) WHEN 6 THEN 'a b c the it of' WHEN 7 THEN p_name WHEN 8 THEN concat('x', p_size, ' and y', p_size) WHEN 9 THEN 'me@x.org' WHEN 10 THEN 'B appendix' ELSE 'EXPERIMENTAL SETUP' END"""


@_query(f"""
WITH l AS (SELECT p_partkey, trim(regexp_replace({_LINE}, '\\s+', ' ', 'g')) AS x, p_partkey % 12 AS k FROM part), f AS (SELECT *, len(regexp_extract_all(' ' || x, '[^A-Za-z][-+]?[0-9]+(?:[.][0-9]+)?(?:/[0-9]+(?:[.][0-9]+)?)?')) AS n, string_split(x, ' ') AS w FROM l),
t AS (SELECT *, contains(x, '@') OR n >= 2 OR (regexp_matches(x, '(?i)(#|%|AP(val|50|75|s|m|l)?\\b|FID\\b|F1\\b|Acc[.]?|Params?[.]?|GFLOPs?|FLOPs?|Latency|Epochs?)') AND len(w) >= 3) OR (len(w) >= 5 AND len(list_filter(w, lambda v: length(v) <= 4)) / len(w)::DOUBLE > 0.65e0) AS tabular FROM f)
SELECT p_partkey, tabular, k IN (1, 3, 10, 11) OR k = 0 AS heading FROM t""")
def heading_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_LINE).alias("x"))
    return p.select("p_partkey", T.table_like(F.col("x")).alias("tabular"), T.section_heading(F.col("x")).alias("heading"))
