"""Queries of gold matching, table views and prompt budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..session import table
from .fixtures import KIND, LABEL

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_GOLD = "CASE WHEN p_partkey % 7 = 6 THEN '' ELSE concat('Table ', p_size % 9) END"


@_query(f"""
WITH g AS (SELECT p_partkey AS gold_id, p_partkey % 30 AS paper_id, p_partkey % 4 AS page, CASE WHEN p_partkey % 7 = 6 THEN 'text_span' ELSE 'table' END AS gk, lower({_GOLD}) AS gl, p_name || ' number ' || p_size AS gt FROM part WHERE p_partkey % 11 = 0),
r AS (SELECT p_partkey AS record_id, p_partkey % 30 AS paper_id, p_partkey % 4 AS page, CASE WHEN p_partkey % 3 = 0 THEN 'text_span' ELSE 'table' END AS rk, lower(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('Table ', p_size % 9) END) AS rl, p_name || ' number ' || p_size AS rt FROM part WHERE p_partkey % 11 <> 0),
j AS (SELECT g.*, r.record_id, r.rk, r.rl, CASE WHEN gk = rk AND gk = 'text_span' THEN len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(gt), '[a-z0-9]+'), lambda t: length(t) > 2)), list_distinct(list_filter(regexp_extract_all(lower(rt), '[a-z0-9]+'), lambda t: length(t) > 2))))
  / least(len(list_distinct(list_filter(regexp_extract_all(lower(gt), '[a-z0-9]+'), lambda t: length(t) > 2))), len(list_distinct(list_filter(regexp_extract_all(lower(rt), '[a-z0-9]+'), lambda t: length(t) > 2))))::DOUBLE ELSE 0e0 END AS o FROM g LEFT JOIN r USING (paper_id, page)),
l AS (SELECT *, CASE WHEN record_id IS NOT NULL AND gk = rk AND gl <> '' AND gl = rl THEN 4 WHEN record_id IS NOT NULL AND o >= 0.35e0 THEN 3 WHEN record_id IS NOT NULL AND gk = rk THEN 2 WHEN record_id IS NOT NULL THEN 1 ELSE 0 END AS level FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY level DESC, o DESC, record_id) AS rn, min(CASE WHEN gk = rk THEN record_id END) OVER (PARTITION BY gold_id) AS relaxed_id FROM l)
SELECT gold_id, ['none', 'page', 'source_type', 'text_overlap', 'locator'][level + 1] AS level, CASE WHEN level >= CASE WHEN gk = 'text_span' THEN 2 ELSE 4 END THEN record_id END AS record_id, relaxed_id FROM k WHERE rn = 1""")
def gold_matches(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    place = [(F.col("p_partkey") % 30).alias("paper_id"), (F.col("p_partkey") % 4).alias("page")]
    text = F.concat("p_name", F.lit(" number "), "p_size").alias("text")
    gold = p.where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("gold_id"), *place, F.when(F.col("p_partkey") % 7 == 6, "text_span").otherwise("table").alias("kind"), F.expr(_GOLD).alias("label"), text)
    own = F.col("p_partkey") % 3 == 0
    records = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("at"), *place, F.when(own, "text_span").otherwise("table").alias("kind"), F.when(own, "").otherwise(F.concat(F.lit("Table "), F.col("p_size") % 9)).alias("label"), text)
    return M.match_gold(gold, records)


@_query("""
WITH r AS (SELECT conv_id, turn, text AS label, role = 'assistant' AS v FROM conversations) SELECT conv_id, turn, sha256(last_value(CASE WHEN NOT v THEN label END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS "group" FROM r""")
def table_groups(spark, sf_dir):
    """Whole labels, as digests."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("label"), (F.col("role") == "assistant").alias("v"))
    return M.group_labels(rows, "conv_id", "turn", "label", "v").select("conv_id", "turn", F.sha2("group", 256).alias("group"))


@_query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r FROM documents),
h AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')), ['the', 'and', 'die', 'que', 'les'])) AS hits FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, r) AS rn, max(r) OVER (PARTITION BY doc_id) AS last FROM h)
SELECT doc_id, r::INT AS "row", hits::INT AS hits FROM k WHERE r = 0 OR r = last OR rn <= 3 AND hits > 0""")
def compact_tables(spark, sf_dir):
    return _compact(table(spark, sf_dir, "documents"))


def _compact(documents):
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "text"))
    return M.compact_table(rows, "doc_id", ["the", "and", "die", "que", "les"], 3).select("doc_id", "row", "hits")


@_query()
def prompt_coverage_pack(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("query_id"), F.col("p_partkey").alias("record_id"), (F.col("p_size") % 6).alias("paper_id"), F.expr(KIND).alias("kind"), F.expr(LABEL).like("Table%").alias("target"), F.col("p_retailprice").alias("score"), (F.col("p_size") * 40).alias("size"))
    return M.coverage_prompt(p, "query_id", 12_000)
