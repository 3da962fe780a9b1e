"""Queries of claims, focused contexts, remapped rows and regular records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as C
from ..session import table
from .fixtures import KIND, LABEL, SQL_QUESTIONS, questions

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query("""
WITH c AS (SELECT user_id % 25 AS query_id, event_id % 3 AS claim_id, event_type, event_id AS unit_id, user_id AS section_id, value AS score FROM events),
o AS (SELECT *, event_type = ['click', 'view', 'nothing'][claim_id + 1] AS own FROM c), a AS (SELECT *, bool_or(own) OVER (PARTITION BY query_id, claim_id) AS anyown FROM o), k AS (SELECT * FROM a WHERE own OR NOT anyown),
v AS (SELECT query_id, section_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.5e0) AS v FROM k WINDOW w AS (PARTITION BY query_id, claim_id)), b AS (SELECT query_id, section_id, max(v) AS claimed FROM v GROUP BY ALL),
s AS (SELECT user_id % 25 AS query_id, user_id AS section_id, count(*)::DOUBLE AS score FROM events GROUP BY user_id), j AS (SELECT s.*, coalesce(claimed, 0e0) AS claimed FROM s LEFT JOIN b USING (query_id, section_id)),
n AS (SELECT *, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.5e0) AS x, coalesce((claimed - min(claimed) OVER w) / nullif(max(claimed) OVER w - min(claimed) OVER w, 0), 0.5e0) AS y FROM j WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, section_id, round((0.6e0 * x + 0.4e0 * y) / 1e0, 6) AS fused FROM n) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, section_id) AS place FROM f""")
def claim_fusion(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    types = F.array(F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("nothing")), (F.col("event_id") % 3 + 1).cast("int")))
    scores = e.select((F.col("user_id") % 25).alias("query_id"), (F.col("event_id") % 3).alias("claim_id"), types.alias("types"), F.col("event_id").alias("unit_id"), F.col("user_id").alias("section_id"), F.col("event_type").alias("kind"), F.col("value").alias("score"))
    sections = e.groupBy((F.col("user_id") % 25).alias("query_id"), F.col("user_id").alias("section_id")).agg(F.count("*").cast("double").alias("score")).withColumn("rank", F.lit(0))
    return C.fused_sections(scores, sections)


@_query("""
WITH r AS (SELECT o_custkey % 60 AS query_id, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'K' || (o_orderkey % 9) END AS claim_id, trim(CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority || ' ' || (o_orderkey % 13) END) AS claim FROM orders),
d AS (SELECT query_id, claim, min(pos) AS pos, min_by(claim_id, pos) FILTER (WHERE true) AS x FROM r WHERE claim <> '' GROUP BY ALL), e AS (SELECT d.query_id, d.claim, d.pos, r.claim_id FROM d JOIN r ON d.query_id = r.query_id AND d.pos = r.pos),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM e), n AS (SELECT query_id, coalesce(claim_id, printf('Q%02d', place)) AS claim_id, claim, place FROM p WHERE place <= 8), i AS (SELECT *, row_number() OVER (PARTITION BY query_id, claim_id ORDER BY place) AS i FROM n)
SELECT query_id, claim_id, claim, place FROM i WHERE i = 1""")
def valid_claims(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("K"), F.col("o_orderkey") % 9))
    text = F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise(F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey") % 13))
    return C.valid_claims(o.select((F.col("o_custkey") % 60).alias("query_id"), F.col("o_orderkey").alias("at"), key.alias("claim_id"), text.alias("claim")), 8)


@_query(f"""
WITH {SQL_QUESTIONS}, r AS (SELECT DISTINCT p_partkey % 50 AS query_id, p_partkey AS record_id, p_name || ' ' || p_type || ' table ' || p_size AS text, {KIND} AS kind FROM part),
s AS (SELECT query_id, record_id, kind, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS n FROM r JOIN questions USING (query_id)),
p AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, kind = 'table' DESC, record_id) AS place FROM s) SELECT * FROM p WHERE place <= 12""")
def focused_context(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("query_id"), F.col("p_partkey").alias("record_id"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" table "), "p_size").alias("text"), F.expr(KIND).alias("kind"))
    return C.focused_context(p, questions(spark, sf_dir))


@_query(f"""
WITH i AS (SELECT p_partkey % 40 AS paper_id, p_size % 5 AS page, p_partkey AS pos, {KIND} AS kind, {LABEL} AS label, CASE WHEN p_partkey % 9 = 0 THEN 'n/a' WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_name || '  ' || p_type END AS text FROM part), n AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY paper_id, page ORDER BY pos) AS k FROM i)
SELECT paper_id, page, printf('%s::p%03d_r%04d', paper_id::VARCHAR, page, k) AS record_id, CASE kind WHEN 'table' THEN 'table' WHEN 'figure' THEN 'figure' WHEN 'citation_context' THEN 'citation_context' WHEN 'equation' THEN 'equation_algorithm' WHEN 'reference' THEN 'citation_context' WHEN 'algorithm' THEN 'equation_algorithm' ELSE 'text_span' END AS source_type, CASE WHEN t = '' THEN 'empty' WHEN lower(t) = 'n/a' THEN 'placeholder' ELSE 'accepted' END AS status FROM n""")
def regular_records(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 9 == 0, "n/a").when(F.col("p_partkey") % 11 == 0, " ").otherwise(F.concat("p_name", F.lit("  "), "p_type"))
    items = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("paper_id"), (F.col("p_size") % 5).alias("page"), F.col("p_partkey").alias("at"), F.expr(KIND).alias("kind"), F.expr(LABEL).alias("label"), text.alias("text"))
    return C.regular_records(items).select("paper_id", "page", "record_id", "source_type", "status")


@_query("SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber)")
def counted_references(spark, sf_dir):
    return C.counted_references(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("number")), "k")


@_query()
def remapped_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("s"), (F.col("p_partkey") % 4).alias("row"), F.concat("p_brand", F.lit("@"), F.col("p_partkey") % 3).alias("key"), F.col("p_name").alias("value"), F.concat(F.lower("p_brand"), F.lit("_at_"), F.col("p_partkey") % 5).alias("name"))
    return C.remapped_rows(p, p, "s").select("s", "row", F.size("values").alias("n"), F.size(F.filter(F.map_values("values"), lambda v: v.isNotNull())).alias("filled"))
