"""Retrieval, scoring and fusion queries."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..operators import bm25, hybrid, joins as J, scoring as S, sparse
from ..session import staged, table
from .fixtures import SQL_PAPERS, papers

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _postings(spark: SparkSession, sf_dir: str) -> bm25.Postings:
    """What BM25 of every benchmark text over all documents is made of."""
    return bm25.postings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), doc_key="doc_id", query_key="item_id")


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """item_id, doc_id, score, rank: the k best documents of every benchmark text by BM25."""
    return bm25.best(_postings(spark, sf_dir), k)


_BM25 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
t AS (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT count(*) AS n, sum(len(toks)) / count(*)::DOUBLE AS avgdl FROM d),
scores AS (SELECT item_id, doc_id, round(sum(qtf * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * greatest(1, len) / greatest(avgdl, 1e-9)))), 6) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term), s GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
"""


@_query(_BM25 + "SELECT * FROM ranked WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    return _best(spark, sf_dir, 5)


@_query(_BM25 + """, m AS (SELECT item_id, doc_id, round((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 6) AS x FROM ranked WHERE rank <= 50 WINDOW w AS (PARTITION BY item_id))
SELECT item_id, doc_id, coalesce(x, 0.5e0) AS half, coalesce(x, 0e0) AS zero FROM m""")
def minmax_norm(spark, sf_dir):
    top = _best(spark, sf_dir, 50)
    return top.select("item_id", "doc_id", F.round(S.min_max("score", ["item_id"]), 6).alias("half"), F.round(S.min_max("score", ["item_id"], 0.0), 6).alias("zero"))


@_query("""
WITH s AS (SELECT user_id, value, max(value) OVER (PARTITION BY user_id) AS top, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rn FROM events)
SELECT user_id, round(avg(value), 6) AS mean, max(value) AS maximum, round(avg(value) FILTER (WHERE rn <= 3), 6) AS top_mean, round(max(top) + ln(avg(exp(3e0 * (value - top)))) / 3e0, 6) AS lme FROM s GROUP BY user_id""")
def score_pooling(spark, sf_dir):
    out = S.pooled(table(spark, sf_dir, "events"), ["user_id"], "value", sharpness=3.0, k=3)
    return out.select("user_id", *[F.round(c, 6).alias(c) if c != "maximum" else c for c in ("mean", "maximum", "top_mean", "lme")])


@_query(_BM25 + """, two AS (SELECT item_id, doc_id, score, length(text) AS n, row_number() OVER (PARTITION BY item_id ORDER BY length(text) DESC, doc_id) AS r2, rank AS r1 FROM ranked JOIN documents USING (doc_id) WHERE rank <= 40),
f AS (SELECT *, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.5e0) AS a, coalesce((n - min(n) OVER w) / nullif(max(n) OVER w - min(n) OVER w, 0)::DOUBLE, 0.5e0) AS b FROM two WINDOW w AS (PARTITION BY item_id))
SELECT item_id, doc_id, round(0.6e0 * a + 0.4e0 * b, 6) AS fused, round(1e0 / (60 + r1) + 1e0 / (60 + r2), 9) AS rrf FROM f""")
def score_fusion(spark, sf_dir):
    top = _best(spark, sf_dir, 40).join(table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    top = top.withColumn("r2", S.rank_by(["item_id"], F.desc("n"), F.asc("doc_id")))
    return top.select("item_id", "doc_id", F.round(0.6 * S.min_max("score", ["item_id"]) + 0.4 * S.min_max("n", ["item_id"]), 6).alias("fused"), F.round(S.reciprocal_rank("rank", "r2"), 9).alias("rrf"))


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@_query(f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS hit, round({_DOT} / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, max(score) AS best, round(avg(hit::INT), 6) AS label_precision, sum(vec_id)::BIGINT AS ids FROM r WHERE rank <= 5 GROUP BY query_id""")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("ql"))  # a stated query set
    near = S.nearest_pairs(asked.select("query_id", "q"), e.select("vec_id", "embedding"), 5)
    pairs = near.join(asked, "query_id").join(e, "vec_id").select("query_id", "vec_id", (F.col("ql") == F.col("label")).alias("hit"), F.round(S.cosine("q", "embedding"), 6).alias("score"))
    top = bm25.top_k(pairs, 5, query_key="query_id", doc_key="vec_id")
    return top.groupBy("query_id").agg(F.max("score").alias("best"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("label_precision"), F.sum("vec_id").alias("ids"))


@_query(_BM25 + """, full_ AS (SELECT * FROM ranked WHERE rank <= 5), sub AS (SELECT item_id, doc_id, score, rank FROM ranked WHERE rank % 2 = 0 AND rank <= 8),
m AS (SELECT item_id, doc_id, score + 2 * (6 - rank) AS part FROM full_ UNION ALL SELECT item_id, doc_id, 0.35e0 * score + 24 * (5 - rank // 2) FROM sub),
merged AS (SELECT item_id, doc_id, round(sum(part), 4) AS score FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM merged)
SELECT * FROM r WHERE rank <= 5""")
def decomposed_merge(spark, sf_dir):
    ranked = _best(spark, sf_dir, 8).withColumnsRenamed({"item_id": "query_id", "doc_id": "paper_id"})
    sub = ranked.where("rank % 2 = 0").withColumn("rank", F.expr("rank div 2"))
    return hybrid.decomposed(ranked, sub, k=5).withColumnsRenamed({"query_id": "item_id", "paper_id": "doc_id"})


@_query(_BM25 + """, base AS (SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 3),
route AS (SELECT r.*, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, r.doc_id) AS k FROM ranked r JOIN documents d USING (doc_id) WHERE d.source = 'src' || (item_id % 20)),
new AS (SELECT item_id, doc_id, score, k FROM route WHERE k <= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.item_id = route.item_id AND b.doc_id = route.doc_id))
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY route, rank, doc_id) AS rank FROM (SELECT item_id, doc_id, score, rank, 0 AS route FROM base UNION ALL SELECT item_id, doc_id, score, k, 1 FROM new)""")
def venue_route(spark, sf_dir):
    p = _postings(spark, sf_dir)
    base = bm25.best(p, 3)
    routed = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("source")), "source").select("item_id", "doc_id")
    extra = bm25.top_k(bm25.scored(p, routed), 3, query_key="item_id", doc_key="doc_id")
    names = {"item_id": "query_id", "doc_id": "paper_id"}
    return hybrid.append_route(base.withColumnsRenamed(names), extra.withColumnsRenamed(names)).withColumnsRenamed({v: k for k, v in names.items()})


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@_query(f"""
WITH {SQL_PAPERS}, w AS (SELECT paper_id, t, sum(x) AS tf FROM (SELECT paper_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t, 3 AS x FROM papers UNION ALL SELECT paper_id, unnest(regexp_extract_all(lower(abstract), '[a-z0-9]+')), 1 FROM papers) WHERE t NOT IN ({_STOP}) GROUP BY ALL),
i AS (SELECT t, 1e0 + ln((SELECT count(*) FROM papers) / count(*)::DOUBLE) AS idf FROM w GROUP BY t), v AS (SELECT paper_id, t, tf * idf AS x FROM w JOIN i USING (t)),
q AS (SELECT item_id, t, count(*) * any_value(idf) AS x FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark) JOIN i USING (t) WHERE t NOT IN ({_STOP}) GROUP BY item_id, t),
vn AS (SELECT paper_id, sqrt(sum(x * x)) AS n FROM v GROUP BY paper_id), qn AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM q GROUP BY item_id),
c AS (SELECT item_id, paper_id, round(sum(q.x * v.x) / (any_value(qn.n) * any_value(vn.n)), 6) AS cosine FROM q JOIN v USING (t) JOIN qn USING (item_id) JOIN vn USING (paper_id) GROUP BY item_id, paper_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, paper_id) AS rank FROM c)
SELECT * FROM r WHERE rank <= 5""")
def topic_cosine(spark, sf_dir):
    title, abstract = T.tokens(F.col("title")), T.tokens(F.col("abstract"))
    words = F.filter(F.concat(title, title, title, abstract), lambda w: ~w.isin(*T.STOPWORDS))
    held = sparse.bags(papers(spark, sf_dir), "paper_id", words)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.tokens(F.col("text"))).alias("term")).where(~F.col("term").isin(*T.STOPWORDS)).groupBy("query_id", "term").agg(F.count("*").alias("c"))
    scores = hybrid.topic_cosine(held, asked, "paper_id").withColumnsRenamed({"query_id": "item_id", "cosine": "score"})
    return bm25.top_k(scores, 5, query_key="item_id", doc_key="paper_id").withColumnRenamed("score", "cosine")


@_query(_BM25 + """, tokens AS (SELECT doc_id, term, tf::DOUBLE / len AS f FROM tf), i AS (SELECT term, ln((2e0 + n) / (1e0 + df + 1)) + 1e0 AS idf FROM df, s),
qn AS (SELECT item_id, term, qtf / sum(qtf) OVER (PARTITION BY item_id) AS f FROM asked),
c AS (SELECT item_id, doc_id, sum(q.f * idf * t.f * idf) AS dot FROM qn q JOIN i USING (term) JOIN tokens t USING (term) GROUP BY ALL)
SELECT item_id, doc_id, round(dot * 1e6, 3) AS dot FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(dot, 9) DESC, doc_id) AS rank FROM c) WHERE rank <= 5""")
def tfidf_dot(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    q = asked.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))
    q = q.withColumn("qf", F.col("qtf") / F.sum("qtf").over(W.partitionBy("item_id")))
    n = docs.agg(F.count("*").alias("n"))  # one row
    tf = staged(bm25.term_counts(docs, q, doc_key="doc_id"), "counts", sparse.TERM_ROWS)
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((2.0 + F.col("n")) / (2.0 + F.col("df"))) + 1.0).alias("idf"))
    weights = staged(q.join(idf, "term"), "weights")
    c = sparse.shared(tf, weights, key="doc_id", pairs=n.first()["n"] * asked.count(), words=lambda rows: rows).groupBy("item_id", "doc_id").agg(F.sum(F.col("qf") * F.col("idf") * F.col("tf") / F.col("len") * F.col("idf")).alias("dot"))
    c = c.withColumn("rank", S.rank_by(["item_id"], F.desc(F.round("dot", 9)), F.asc("doc_id"))).where("rank <= 5")
    return c.select("item_id", "doc_id", F.round(F.col("dot") * 1e6, 3).alias("dot"))


@_query("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM documents), s AS (SELECT count(*) AS n FROM documents),
t AS (SELECT doc_id, term, count(*) / any_value(len)::DOUBLE AS f FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id, term, count(*) / sum(count(*)) OVER (PARTITION BY item_id) AS f FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT item_id, term, f, ln((n + 2e0) / (coalesce(df, 0) + 2e0)) + 1 AS w FROM q LEFT JOIN df USING (term), s), qn AS (SELECT item_id, sum((f * w) ^ 2) AS own FROM w GROUP BY item_id),
z AS (SELECT doc_id, term, f, ln((n + 2e0) / (df + 1e0)) + 1 AS v FROM t JOIN df USING (term), s), dn AS (SELECT doc_id, sum((f * v) ^ 2) AS norm FROM z GROUP BY doc_id),
c AS (SELECT item_id, doc_id, sum(w.f * w * z.f * w) AS dot, sum(z.f ^ 2 * (w ^ 2 - v ^ 2)) AS change FROM w JOIN z USING (term) GROUP BY ALL),
r AS (SELECT item_id, doc_id, round(dot / sqrt(own * (norm + change)), 9) AS cosine FROM c JOIN qn USING (item_id) JOIN dn USING (doc_id))
SELECT item_id, doc_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, doc_id) AS rank FROM r) WHERE rank <= 5""")
def tfidf_cosine(spark, sf_dir):
    rows = hybrid.tfidf_cosine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), doc_key="doc_id", query_key="item_id")
    return bm25.top_k(rows.withColumnRenamed("cosine", "score"), 5, query_key="item_id", doc_key="doc_id").select("item_id", "doc_id", F.round("score", 6).alias("cosine"), "rank")


@_query(f"""
WITH {SQL_PAPERS}, a AS (SELECT paper_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS term FROM papers), d AS (SELECT term, count(*) AS df FROM a GROUP BY term)
SELECT query_id, paper_id, round(sum(CASE WHEN length(term) <= 3 AND df > 80 THEN 4e0 ELSE greatest(CASE WHEN length(term) <= 3 THEN 10e0 ELSE 18e0 END, CASE WHEN length(term) <= 3 THEN 75e0 ELSE 95e0 END / sqrt(df)) END), 6) AS boost FROM a JOIN d USING (term) JOIN (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) USING (term) GROUP BY query_id, paper_id""")
def alias_exact_boost(spark, sf_dir):
    p = papers(spark, sf_dir).select("paper_id", F.array_distinct(T.tokens(F.col("title"))).alias("aliases"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.tokens(F.col("text"))).alias("terms"))
    return hybrid.alias_boost(p, asked).select("query_id", "paper_id", F.round("alias_boost", 6).alias("boost"))


@_query(f"""
WITH {SQL_PAPERS}, k AS (SELECT paper_id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS t, regexp_replace(lower(substr(abstract, 1, 2400)), '[^a-z0-9]+', '', 'g') AS a, regexp_replace(lower(title || ' ' || abstract), '[^a-z0-9]+', '', 'g') AS x FROM papers),
q AS (SELECT unnest(['tion', 'thanedble', 'bleanin', 'ing', 'reation']) AS term)
SELECT paper_id, sum(CASE WHEN length(term) >= 4 AND contains(t, term) THEN 90e0 WHEN length(term) >= 5 AND contains(a, term) THEN 30e0 WHEN length(term) >= 5 AND contains(x, term) THEN 18e0 ELSE 0e0 END) AS boost FROM k, q GROUP BY paper_id""")
def containment_boost(spark, sf_dir):
    boost = F.lit(0.0)
    for term in ("tion", "thanedble", "bleanin", "ing", "reation"):
        long = len(term) >= 5
        hit = F.when(F.lit(len(term) >= 4) & F.col("t").contains(term), hybrid.IN_TITLE).when(F.lit(long) & F.col("a").contains(term), hybrid.IN_ABSTRACT).when(F.lit(long) & F.col("x").contains(term), hybrid.IN_TEXT).otherwise(0.0)
        boost = boost + hit
    keys = papers(spark, sf_dir).select("paper_id", T.compact(F.col("title")).alias("t"), T.compact(F.substring("abstract", 1, 2400)).alias("a"), T.compact(F.concat_ws(" ", "title", "abstract")).alias("x"))
    return keys.select("paper_id", boost.alias("boost"))


_PRIOR = "CASE WHEN n <= 0 THEN 0e0 WHEN page <= 2 THEN 0.8e0 WHEN kind IN ('table', 'figure') AND page / n::DOUBLE BETWEEN 0.35e0 AND 0.85e0 THEN 0.7e0 WHEN kind = 'citation_context' AND page / n::DOUBLE >= 0.75e0 THEN 0.9e0 WHEN kind = 'text_span' AND page / n::DOUBLE BETWEEN 0.15e0 AND 0.7e0 THEN 0.5e0 ELSE 0e0 END"
_PAGE = "l_orderkey, l_linenumber AS page, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE l_orderkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'citation_context' ELSE 'text_span' END AS kind"


@_query(f"WITH p AS (SELECT {_PAGE} FROM lineitem) SELECT l_orderkey, page, {_PRIOR} AS prior, CASE page WHEN 1 THEN 3e0 WHEN 2 THEN 2e0 WHEN 3 THEN 1e0 ELSE 0e0 END AS rank_prior FROM p")
def page_position_prior(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), F.count("*").over(W.partitionBy("l_orderkey")).alias("n"), F.element_at(F.array(*map(F.lit, ("table", "figure", "citation_context", "text_span"))), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("kind"))
    part, kind = F.col("page") / F.col("n"), F.col("kind")
    prior = F.when(F.col("page") <= 2, 0.8).when(kind.isin("table", "figure") & part.between(0.35, 0.85), 0.7).when((kind == "citation_context") & (part >= 0.75), 0.9).when((kind == "text_span") & part.between(0.15, 0.7), 0.5).otherwise(0.0)
    return pages.select("l_orderkey", "page", prior.alias("prior"), F.when(F.col("page") <= 3, 4.0 - F.col("page")).otherwise(0.0).alias("rank_prior"))


@_query(_BM25 + """, u AS (SELECT r.item_id, r.doc_id, score, d.source IN ('src1', 'src2') AS special FROM ranked r JOIN documents d USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, special ORDER BY score DESC, doc_id) AS rn FROM u)
SELECT item_id, count(*) AS pool, count(*) FILTER (WHERE special) AS special FROM k WHERE special OR rn <= 16 GROUP BY item_id""")
def retriever_pool(spark, sf_dir):
    p = _postings(spark, sf_dir)
    rows = p.rows.join(table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("source").isin("src1", "src2"), F.lit(False)).alias("special")), "doc_id")
    special, others = (dataclasses.replace(p, rows=rows.where(c).drop("special")) for c in ("special", "NOT special"))
    u = bm25.every(special).withColumn("special", F.lit(True)).unionByName(bm25.best(others, 16).drop("rank").withColumn("special", F.lit(False)))
    pool = J.retriever_pool(u.withColumnRenamed("doc_id", "unit"), "item_id", 16)
    return pool.groupBy("item_id").agg(F.count("*").alias("pool"), F.count_if("special").alias("special"))
