"""Queries of answer repair, bonuses and navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..session import table

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query("SELECT l_returnflag AS kind, count(*) AS n, round(avg((l_partkey % 3 = 0)::INT), 6) AS recall_a, round(avg((l_suppkey % 2 = 0)::INT), 6) AS recall_b, count(*) FILTER (WHERE l_partkey % 3 = 0 AND l_suppkey % 2 <> 0) AS only_a, count(*) FILTER (WHERE l_suppkey % 2 = 0 AND l_partkey % 3 <> 0) AS only_b FROM (SELECT l_returnflag, l_partkey, l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag HAVING count(*) = 1) GROUP BY 1")
def paired_recall(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("c")).where("c = 1")
    item = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("item")
    return A.paired_recall(l.select(item, F.col("l_returnflag").alias("kind"), (F.col("l_partkey") % 3 == 0).alias("hit")), l.select(item, (F.col("l_suppkey") % 2 == 0).alias("hit")), "kind")


@_query("SELECT o_custkey AS k, min(o_orderstatus) AS value FROM (SELECT *, max(o_orderkey % 7) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE o_orderkey % 7 = top GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def unambiguous_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("value"), (F.col("o_orderkey") % 7).alias("score"))
    return A.single_value(rows, "k")


@_query("SELECT r AS record_id, max(o_totalprice) AS dense, max(o_orderkey % 100) AS lexical FROM (SELECT o_totalprice, o_orderkey, unnest([o_custkey % 60, o_orderkey % 60]) AS r FROM orders) GROUP BY 1")
def anchor_score_tracks(spark, sf_dir):
    units = table(spark, sf_dir, "orders").select(F.array(F.col("o_custkey") % 60, F.col("o_orderkey") % 60).alias("record_ids"), F.col("o_totalprice").alias("dense"), (F.col("o_orderkey") % 100).alias("lexical"))
    return A.anchor_scores(units, ["dense", "lexical"])


@_query("""
WITH s AS (SELECT p_partkey, len(list_intersect(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(p_type || ' part 1 2 3 4 5'), '[a-z0-9]+')))) AS n, p_size / 50e0 AS v, p_partkey % 3 = 0 AS sp FROM part)
SELECT p_partkey, round(least(0.8e0, n * 0.12e0), 6) AS title_bonus, round(v + least(0.1e0, 0.1e0 * n) + CASE WHEN sp THEN least(0.1e0, 0.15e0 * n) ELSE 0e0 END, 6) AS unit, round(sp::INT * 1e0 + (p_partkey % 5 = 0)::INT * 3e0 + (p_size > 25)::INT * 0.1e0, 6) AS layout FROM s JOIN part USING (p_partkey)""")
def bounded_bonuses(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    q = F.concat("p_type", F.lit(" part 1 2 3 4 5"))
    n = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("p_name"))), F.array_distinct(T.tokens(q))))
    special = F.col("p_partkey") % 3 == 0
    return p.select("p_partkey", F.round(A.section_bonus(q, F.col("p_name")), 6).alias("title_bonus"), F.round(A.bounded_unit_score(F.col("p_size") / 50.0, n, special), 6).alias("unit"), F.round(A.layout_score(special, F.col("p_partkey") % 5 == 0, F.col("p_size") > 25), 6).alias("layout"))


@_query("""
WITH r AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS k, doc_id, text FROM documents), q AS (SELECT DISTINCT item_id AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
o AS (SELECT r.k, doc_id, q.term FROM (SELECT DISTINCT k, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM r) r JOIN q ON r.k = q.k AND r.term = q.term), n AS (SELECT k, count(*) AS n FROM r GROUP BY k), d AS (SELECT k, term, ln(1e0 + n / count(*)::DOUBLE) AS w FROM o JOIN n USING (k) GROUP BY k, term, n),
s AS (SELECT k, doc_id AS record_id, round(sum(w), 6) AS score FROM o JOIN d USING (k, term) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, record_id) AS place FROM s) SELECT * FROM p WHERE place <= 4""")
def navigation_seeds(spark, sf_dir):
    """The questions share all documents out among them."""
    b = table(spark, sf_dir, "benchmark")
    r = table(spark, sf_dir, "documents").select((F.col("doc_id") % (b.count() or 1)).alias("k"), F.col("doc_id").alias("record_id"), "text")
    return A.navigation(r, b.select(F.col("item_id").alias("k"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")), "k", 4)


@_query("""
WITH f AS (SELECT DISTINCT item_id % 5 AS profile, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), w AS (SELECT profile, term, (length(term) / 10e0) AS weight FROM f WHERE length(term) > 6), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
s AS (SELECT profile, doc_id AS paper_id, round(sum(weight), 6) AS score FROM t JOIN w USING (term) GROUP BY ALL HAVING round(sum(weight), 6) >= 1.5e0), p AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, paper_id) AS place FROM s) SELECT * FROM p WHERE place <= 10""")
def topic_profile_rank(spark, sf_dir):
    f = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("profile"), F.explode(T.tokens(F.col("text"))).alias("term")).distinct().where(F.length("term") > 6)
    return A.profile_rank(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text"), f.withColumn("weight", F.length("term") / 10.0), 1.5, 10)


_BLOCK = "l_orderkey AS k, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS block_id, l_partkey % 100 AS x0, l_suppkey % 100 AS y0, l_partkey % 100 + 10 AS x1, l_suppkey % 100 + 5 AS y1, concat('block of text ', l_partkey) AS text, l_linenumber"


@_query(f"WITH b AS (SELECT {_BLOCK} FROM lineitem) SELECT k, block_id FROM b WHERE l_linenumber > 2 AND length(trim(text)) >= 16 AND NOT EXISTS (SELECT 1 FROM b u WHERE u.l_linenumber <= 2 AND u.k = b.k AND b.x0 < u.x1 AND u.x0 < b.x1 AND b.y0 < u.y1 AND u.y0 < b.y1)")
def unclaimed_blocks(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").selectExpr(*["l_orderkey as k", "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey as block_id", "l_partkey % 100 as x0", "l_suppkey % 100 as y0", "l_partkey % 100 + 10 as x1", "l_suppkey % 100 + 5 as y1", "concat('block of text ', l_partkey) as text", "l_linenumber"])
    return A.unclaimed_blocks(b.where("l_linenumber > 2"), b.where("l_linenumber <= 2"), "k", least_chars=16).select("k", "block_id")


@_query("SELECT query_id, paper_id, key, bool_or(own) AS own FROM (SELECT o_custkey % 40 AS query_id, o_orderstatus AS paper_id, o_orderpriority AS key, true AS own FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_custkey % 40, o_orderstatus, o_orderpriority, false FROM orders WHERE o_orderkey % 3 <> 0) GROUP BY ALL")
def expanded_grounding(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("query_id"), F.col("o_orderstatus").alias("paper_id"), F.col("o_orderpriority").alias("key"), "o_orderkey")
    return A.expanded(o.where("o_orderkey % 3 = 0").drop("o_orderkey"), o.where("o_orderkey % 3 <> 0").drop("o_orderkey"))


@_query("SELECT o_custkey AS query_id, min(o_orderpriority) AS paper_id FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def sole_paper_gate(spark, sf_dir):
    return A.sole_paper_gate(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("paper_id")), "query_id")


@_query("""
WITH r AS (SELECT p_partkey % 30 AS q, p_brand AS paper_id, p_partkey AS record_id, p_type AS content, p_size AS rank FROM part), c AS (SELECT *, row_number() OVER (PARTITION BY q, content ORDER BY rank, record_id) AS c FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY q, paper_id ORDER BY rank, record_id) AS p FROM c WHERE c = 1),
f AS (SELECT q, record_id, row_number() OVER (PARTITION BY q ORDER BY rank, record_id) AS place FROM p WHERE p <= 2) SELECT * FROM f WHERE place <= 6""")
def visual_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("q"), F.col("p_brand").alias("paper_id"), F.col("p_partkey").alias("record_id"), F.col("p_type").alias("content"), F.col("p_size").alias("rank"))
    return A.capped_visuals(rows, "q", 2, 6)


@_query()
def flattened_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(A.flattened(F.col("props")), "|").alias("flat"))
