"""Queries of page ranking, layout and the evidence hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hierarchy as H, pages as P, scoring as S
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


_PAGE = "concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' Table 3 shows results' WHEN 1 THEN ' Fig. 2 (a) panel' WHEN 2 THEN ' on an A100 gpu setup' WHEN 3 THEN ' equation (4)' WHEN 4 THEN ' see [3, 4]' ELSE ' and accuracy' END)"
_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'text_span' WHEN 3 THEN 'equation_algorithm' ELSE 'citation_context' END"
_SIGNS = "CASE kind " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {w}e0 ELSE 0e0 END" for p, w in signs) for k, signs in P.SIGNS.items()) + " END"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@_query(f"""
WITH {SQL_QUESTIONS}, p AS (SELECT p_partkey, {_PAGE} AS t, {_KIND} AS kind FROM part), q AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))) AS q FROM questions)
SELECT query_id, p_partkey, {_SIGNS} AS signs, round(len(list_intersect(q, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')))) / greatest(1e0, sqrt(len(q) + 1e0)), 6) AS overlap, least(6e0, 1.5e0 * len(list_filter(['accuracy', 'A100', 'results'], lambda x: contains(lower(t), lower(x))))) AS hints FROM p JOIN q ON query_id = p_partkey""")
def structural_scores(spark, sf_dir):
    """Every page with the question of its number."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PAGE).alias("t"), F.expr(_KIND).alias("kind")).join(questions(spark, sf_dir), F.col("query_id") == F.col("p_partkey"))
    t = F.col("t")
    hints = P.capped_hits(F.array(F.lit("accuracy"), F.lit("A100"), F.lit("results")), t, 1.5, 6.0)
    return p.select("query_id", "p_partkey", P.sign_score(F.col("kind"), t).alias("signs"), F.round(P.overlap_score(F.col("question"), t), 6).alias("overlap"), hints.alias("hints"))


@_query("""
WITH v AS (SELECT user_id % 20 AS q, user_id AS page, value AS bm25, (event_id % 100) / 100e0 AS cosine FROM events), s AS (SELECT q, page, 0.75e0 * coalesce((bm25 - min(bm25) OVER w) / nullif(max(bm25) OVER w - min(bm25) OVER w, 0), 0) + 0.25e0 * cosine AS v FROM v WINDOW w AS (PARTITION BY q)),
t AS (SELECT *, max(v) OVER (PARTITION BY q, page) AS top FROM s) SELECT q, page, round(max(top) + ln(avg(exp(4e0 * (v - top)))) / 4e0, 6) AS score FROM t GROUP BY q, page""")
def chunk_hybrid_pages(spark, sf_dir):
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("q"), F.col("user_id").alias("page"), F.col("value").alias("bm25"), ((F.col("event_id") % 100) / 100.0).alias("cosine"))
    return P.pooled_chunks(v, ["q", "page"]).select("q", "page", F.round("score", 6).alias("score"))


@_query()
def paragraph_chunks(spark, sf_dir):
    return P.paragraph_chunks(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


_WORDS = "l_orderkey AS k, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS word_id, l_linenumber % 3 AS line, (l_partkey % 500)::DOUBLE AS x"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.expr("l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey").alias("word_id"), F.expr("l_linenumber % 3").alias("line"), F.expr("cast(l_partkey % 500 as double)").alias("x"), F.expr("cast(l_suppkey % 40 as double)").alias("y"))


@_query(f"""
WITH w AS (SELECT {_WORDS} FROM lineitem), c AS (SELECT k, row_number() OVER (PARTITION BY k, line ORDER BY x, word_id) AS c, x FROM w), m AS (SELECT k, c, avg(x) AS centre FROM c GROUP BY k, c),
d AS (SELECT w.k, w.word_id, m.c, abs(w.x - m.centre) AS d, row_number() OVER (PARTITION BY w.k, w.word_id ORDER BY abs(w.x - m.centre), m.c) AS rn FROM w JOIN m USING (k)) SELECT k, word_id, c AS "column" FROM d WHERE rn = 1 AND d <= 24""")
def layout_columns(spark, sf_dir):
    w = _words(spark, sf_dir)
    return P.to_columns(w, P.column_centres(w, "k"), "k")


@_query()
def layout_lines(spark, sf_dir):
    return P.lines(_words(spark, sf_dir).drop("line"), "k").groupBy("k").agg((F.max("line") + 1).alias("lines"), F.count("*").alias("words"))


@_query()
def caption_claims(spark, sf_dir):
    w = _words(spark, sf_dir).select("k", "word_id", "line", "x", "y")
    box = lambda df, name, side: df.where(F.col("line") == side).select("k", F.col("word_id").alias(name), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 20).alias("x1"), (F.col("y") + 10).alias("y1"))
    return P.claim_captions(box(w, "object_id", 0), box(w, "caption_id", 1), ["k"])


_CARDS = """
WITH c AS (SELECT item_id AS query_id, doc_id, text, printf('E%04d', row_number() OVER (PARTITION BY item_id ORDER BY doc_id)) AS ref FROM (SELECT b.item_id, d.doc_id, d.text FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)),
q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS q FROM benchmark),
s AS (SELECT query_id, ref, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM c),
x AS (SELECT query_id, ref, s, len(list_intersect(q, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')))) AS score FROM s JOIN q USING (query_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, ref ORDER BY score DESC, length(s), s) AS rn FROM x), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(s), ref) AS place FROM b WHERE rn = 1 AND score > 0)
"""


def _catalog(spark, sf_dir):
    """Records of each question, which share all documents out among them."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    documents = table(spark, sf_dir, "documents")
    d = documents.select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("place"), F.col("source").alias("paper_id"), "text")
    return H.catalog(b.join(d, F.col("record_id") % (b.count() or 1) == F.col("query_id")))


def _cards(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return H.extractive_cards(_catalog(spark, sf_dir), q, 5)


@_query(_CARDS + "SELECT query_id, printf('C%03d', place) AS card_key, ref AS evidence_ref, score::INT AS score, length(s)::INT AS n FROM p WHERE place <= 5 AND length(s) <= 520 AND NOT regexp_matches(s, '\\s{2,}')")
def extractive_cards(spark, sf_dir):
    return _card_rows(_cards(spark, sf_dir))


def _card_rows(cards):
    c = cards.where(~F.col("proposition").rlike("…$"))
    return c.select("query_id", "card_key", "evidence_ref", "score", F.length("proposition").alias("n"))


@_query(_CARDS + "SELECT c.query_id, count(*) AS records, (SELECT count(*) FROM p WHERE p.query_id = c.query_id AND place <= 5) AS cards, true AS valid FROM c GROUP BY c.query_id")
def hierarchy_shape(spark, sf_dir):
    return H.shape(_catalog(spark, sf_dir), _cards(spark, sf_dir)).select("query_id", "records", "cards", "valid")


@_query("""
WITH c AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS claim_id FROM orders), d AS (SELECT DISTINCT c_custkey % 50 AS query_id, c_custkey AS claim_id FROM customer)
SELECT query_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.query_id = c.query_id AND d.claim_id = c.claim_id)) = 0 AS sufficient, count(DISTINCT claim_id) FILTER (WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.query_id = c.query_id AND d.claim_id = c.claim_id))::INT AS missing FROM c GROUP BY query_id""")
def structural_sufficiency(spark, sf_dir):
    return _sufficient(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def _sufficient(orders, customers):
    claims = orders.select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").cast("string").alias("claim_id"))
    cards = customers.select((F.col("c_custkey") % 50).alias("query_id"), F.col("c_custkey").cast("string").alias("claim_id"))
    return H.sufficiency(claims, cards).select("query_id", "sufficient", F.size("missing").alias("missing"))


@_query()
def narrated_objects(spark, sf_dir):
    """Rows only: the pattern of a label needs lookaround, which the oracle's engine has not."""
    objects = labelled(spark, sf_dir).select((F.col("record_id") % 20).alias("paper_id"), "record_id", (F.col("record_id") % 3).alias("section_id"), (F.col("record_id") % 7).alias("page"), F.col("record_id").alias("at"), "label", F.lit("table").alias("kind"), F.lit("").alias("text"))
    prose = labelled(spark, sf_dir).select((F.col("record_id") % 20).alias("paper_id"), (F.col("record_id") + 1_000_000).alias("record_id"), (F.col("record_id") % 3).alias("section_id"), (F.col("record_id") % 7).alias("page"), F.col("record_id").alias("at"), F.lit("").alias("label"), F.lit("text_span").alias("kind"), F.concat(F.lit("as "), "label", F.lit(" shows")).alias("text"))
    return H.narrations(objects, prose, 2)


@_query(f"WITH {SQL_LABELS}, r AS (SELECT record_id % 40 AS q, row_number() OVER (PARTITION BY record_id % 40 ORDER BY record_id) AS rank FROM labelled) SELECT q, rank, CASE WHEN rank <= 3 THEN 4e0 - rank ELSE 0e0 END AS prior FROM r")
def candidate_prior(spark, sf_dir):
    rows = labelled(spark, sf_dir).select((F.col("record_id") % 40).alias("q"), "record_id").withColumn("rank", S.rank_by(["q"], F.asc("record_id")))
    return rows.select("q", "rank", P.rank_prior(F.col("rank")).alias("prior"))
