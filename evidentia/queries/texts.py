"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table
from .fixtures import SQL_PAPERS, SQL_QUESTIONS, papers, questions

QUERIES, SQL = {}, {}


def _query(name, sql):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _simple(name, source, columns, sql):
    """A query that projects expressions from a fixture."""

    def run(spark, sf_dir):
        return source(spark, sf_dir).select(*columns())

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


documents = lambda spark, sf_dir: table(spark, sf_dir, "documents")
pages = lambda spark, sf_dir: table(spark, sf_dir, "pages")
join = lambda c: F.array_join(c, " ")

_simple("tokenize", documents, lambda: ["doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_distinct"), F.size(T.content_tokens(F.col("text"))).cast("long").alias("n_content"), T.budget_tokens(F.col("text")).alias("n_budget")], """
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS n_distinct,
  len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)))::BIGINT AS n_content, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_budget FROM documents""")

_simple("compact_text", papers, lambda: ["paper_id", T.compact(F.col("title")).alias("key"), F.length(T.compact(F.col("abstract"))).cast("long").alias("n")], f"""
WITH {SQL_PAPERS} SELECT paper_id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key, length(regexp_replace(lower(abstract), '[^a-z0-9]+', '', 'g'))::BIGINT AS n FROM papers""")

_simple("mask_urls", pages, lambda: ["page_id", T.mask_urls(F.concat_ws(" ", F.lit("see"), "url", F.lit("now"))).alias("masked")], """
SELECT page_id, regexp_replace(concat_ws(' ', 'see', url, 'now'), 'https?://\\S+', '[URL_REMOVED]', 'g') AS masked FROM pages""")

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_simple("title_acronym", papers, lambda: ["paper_id", join(T.title_words(F.col("title"))).alias("words"), T.acronym(T.title_words(F.col("title"))).alias("acronym")], f"""
WITH {SQL_PAPERS}, w AS (SELECT paper_id, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS w FROM papers)
SELECT paper_id, coalesce(list_aggregate(w, 'string_agg', ' '), '') AS words, coalesce(list_aggregate(list_transform(w, lambda x: x[1:1]), 'string_agg', ''), '') AS acronym FROM w""")

_simple("window_acronyms", lambda s, d: papers(s, d).select("paper_id", T.title_words(F.col("title")).alias("w")), lambda: ["paper_id", F.sha2(join(T.window_acronyms(F.col("w"))), 256).alias("aliases")], f"""
WITH {SQL_PAPERS}, w AS (SELECT paper_id, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS w FROM papers), p AS (SELECT paper_id, w, unnest(range(1, len(w))) AS i FROM w),
r AS (SELECT DISTINCT paper_id, list_aggregate(list_transform(w[i:i + n - 1], lambda x: x[1:1]), 'string_agg', '') AS a FROM p, range(2, 7) n(n) WHERE i + n - 1 <= len(w))
SELECT paper_id, sha256(coalesce(string_agg(a, ' ' ORDER BY a), '')) AS aliases FROM w LEFT JOIN r USING (paper_id) GROUP BY paper_id""")

_M, _X, _QT = (p.replace("'", "''") for p in (T.METHOD, T.MIXED_METHOD, T.QUOTED))
_C = lambda x: f"regexp_replace(lower(translate({x}, '²³', '23')), '[^a-z0-9]+', '', 'g')"
_NM = ", ".join(f"'{w}'" for w in T.NON_METHOD_TERMS)


@_query("alias_df", f"""
WITH {SQL_QUESTIONS}, a AS (SELECT DISTINCT query_id, {_C('m')} AS alias FROM (SELECT query_id, unnest(regexp_extract_all(question, '{_M}')) AS m FROM questions) WHERE length(m) BETWEEN 2 AND 30)
SELECT alias, count(*) AS df FROM a GROUP BY alias""")
def alias_df(spark, sf_dir):
    return questions(spark, sf_dir).select(F.explode(T.upper_aliases(F.col("question"))).alias("alias")).groupBy("alias").agg(F.count("*").alias("df"))


_simple("query_terms", questions, lambda: ["query_id", join(T.query_terms(F.col("question"))).alias("terms"), join(T.query_terms(F.col("question"), filtered=False)).alias("raw_terms")], f"""
WITH {SQL_QUESTIONS}, m AS (
  SELECT query_id, {_C('m')} AS t, 1 AS part FROM (SELECT query_id, unnest(regexp_extract_all(question, '{_M}')) AS m FROM questions)
  UNION SELECT query_id, {_C('m')}, 2 FROM (SELECT query_id, unnest(regexp_extract_all(question, '{_X}')) AS m FROM questions)
  UNION SELECT query_id, {_C('m')}, 3 FROM (SELECT query_id, unnest(regexp_extract_all(question, '{_QT}', 1)) AS m FROM questions)
  UNION SELECT query_id, {_C('m')}, 4 FROM (SELECT query_id, unnest(regexp_extract_all(question, '{T.NAMED_PAPER}', 1)) AS m FROM questions)),
f AS (SELECT DISTINCT query_id, t FROM m WHERE length(t) >= CASE part WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AND t NOT IN ({_NM})),
u AS (SELECT DISTINCT query_id, t FROM m WHERE part = 2 AND length(t) >= 3 OR part IN (1, 3) AND length(t) BETWEEN 2 AND 30)
SELECT query_id, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM f WHERE f.query_id = q.query_id), '') AS terms, coalesce((SELECT string_agg(t, ' ' ORDER BY t) FROM u WHERE u.query_id = q.query_id), '') AS raw_terms FROM questions q""")

_simple("query_mentions", questions, lambda: ["query_id", F.array_join(T.query_mentions(F.col("question")), "|").alias("mentions")], f"""
WITH {SQL_QUESTIONS}, n AS (SELECT query_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT query_id, list_concat(regexp_extract_all(question, '{_M}'), list_concat(regexp_extract_all(question, '{_X}'), regexp_extract_all(question, '{_QT}', 1))) AS ms FROM questions)),
d AS (SELECT query_id, {_C('m')} AS key, min_by(trim(m), k) AS m, min(k) AS k FROM n GROUP BY ALL HAVING length({_C('any_value(m)')}) >= 3 AND {_C('any_value(m)')} NOT IN ({_NM})),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rn FROM d)
SELECT query_id, coalesce((SELECT string_agg(m, '|' ORDER BY k) FROM r WHERE r.query_id = q.query_id AND rn <= 16), '') AS mentions FROM questions q""")

_VN = "ACL|NAACL|EMNLP|CVPR|ICCV|ECCV|ICLR|ICML|NeurIPS"
_simple("venue_year_hints", questions, lambda: ["query_id", join(T.venue_hints(F.col("question"))).alias("venues"), join(T.year_hints(F.col("question"))).alias("years"), join(T.adjacent_venue_years(F.col("question"))).alias("adjacent")], rf"""
WITH {SQL_QUESTIONS}, v AS (SELECT query_id, question, list_sort(list_distinct(list_transform(regexp_extract_all(question, '(?i)\b({_VN})\b', 1), lambda x: CASE WHEN upper(x) = 'NEURIPS' THEN 'NeurIPS' ELSE upper(x) END))) AS vs,
  list_sort(list_distinct(regexp_extract_all(question, '\b(20[0-9]{{2}})\b', 1))) AS ys,
  list_transform(regexp_extract_all(question, '(?i)\b(?:{_VN})\s+20[0-9]{{2}}\b|\b20[0-9]{{2}}\s+(?:{_VN})\b'), lambda m: CASE WHEN upper(regexp_extract(m, '(?i)({_VN})', 1)) = 'NEURIPS' THEN 'NeurIPS' ELSE upper(regexp_extract(m, '(?i)({_VN})', 1)) END || '|' || regexp_extract(m, '(20[0-9]{{2}})', 1)) AS a FROM questions)
SELECT query_id, coalesce(list_aggregate(vs, 'string_agg', ' '), '') AS venues, coalesce(list_aggregate(ys, 'string_agg', ' '), '') AS years, coalesce(list_aggregate(list_sort(list_distinct(a)), 'string_agg', ' '), '') AS adjacent FROM v""")

_NORM = lambda x: f"regexp_replace(regexp_replace(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), '^[\"''“”‘’`]+|[\"''“”‘’`]+$', '', 'g'), '\\s+', ' ', 'g')"
_simple("normalize_answer", documents, lambda: ["doc_id", F.sha2(T.normalize_answer(F.concat(F.lit("  “"), "text", F.lit("\"'  "))), 256).alias("answer")], f"""
SELECT doc_id, sha256({_NORM("concat('  “', text, '\"''  ')")}) AS answer FROM documents""")

_NUMBER = "CASE o_orderkey % 6 WHEN 0 THEN concat(round(o_totalprice), '%') WHEN 1 THEN concat(' ', o_custkey, ',000 ') WHEN 2 THEN concat(o_custkey, ' ms') WHEN 3 THEN 'n/a' WHEN 4 THEN concat('-', o_custkey, '.5') ELSE '' END"
_simple("normalize_number", lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(_NUMBER.replace("round(o_totalprice)", "cast(round(o_totalprice) as bigint)")).alias("x")), lambda: ["o_orderkey", T.normalize_number(F.col("x")).alias("plain"), T.coerce_number(F.col("x")).alias("coerced")], f"""
WITH x AS (SELECT o_orderkey, {_NUMBER.replace("round(o_totalprice)", "cast(round(o_totalprice) as bigint)")} AS x FROM orders)
SELECT o_orderkey, try_cast(replace(trim(x), '%', '') AS DOUBLE) AS plain, try_cast(nullif(replace(regexp_extract(trim(x), '^([-+]?[0-9][0-9,]*(?:\\.[0-9]+)?)\\s*[A-Za-z%°µ/]*$', 1), ',', ''), '') AS DOUBLE) AS coerced FROM x""")

_simple("clip_text", documents, lambda: ["doc_id", T.clip(F.col("text"), 80).alias("clipped")], """
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substr(t, 1, 79)) || '…' END AS clipped FROM f""")

_simple("page_text_stats", pages, lambda: ["page_id", F.length(T.page_text(F.col("html"))).cast("long").alias("char_count"), F.size(F.split(T.page_text(F.col("html")), "\n")).cast("long").alias("line_count"), (F.length(T.page_text(F.col("html"))) >= 40).alias("has_native_text")], """
WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(replace(html, chr(0), ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS t FROM pages)
SELECT page_id, length(t)::BIGINT AS char_count, len(string_split(t, chr(10)))::BIGINT AS line_count, length(t) >= 40 AS has_native_text FROM t""")

_simple("sentence_split", documents, lambda: ["doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"), F.coalesce(F.get(T.sentences(F.col("text")), F.lit(0)), F.lit("")).alias("first")], """
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(s[1], '') AS first FROM s""")

_simple("decimal_text", lambda s, d: table(s, d, "customer"), lambda: ["c_custkey", T.decimal_text(F.col("c_acctbal")).alias("shown")], """
SELECT c_custkey, regexp_replace(regexp_replace(c_acctbal::DECIMAL(38,10)::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS shown FROM customer""")


@_query("overlap_scores", """
WITH p AS (SELECT item_id, doc_id, list_distinct(list_filter(regexp_extract_all(lower(b.text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS x, list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS y,
  list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS u, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS v FROM benchmark b JOIN documents d ON b.item_id = d.doc_id)
SELECT item_id, doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0e0 ELSE len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE END, 6) AS coefficient,
  round(CASE WHEN len(u) = 0 OR len(v) = 0 OR len(list_intersect(u, v)) = 0 THEN 0e0 ELSE 2e0 * len(list_intersect(u, v)) / (len(u) + len(v)) END, 6) AS f1 FROM p""")
def overlap_scores(spark, sf_dir):
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a")).join(documents(spark, sf_dir).select("doc_id", F.col("text").alias("b")), F.col("item_id") == F.col("doc_id"))
    return pairs.select("item_id", "doc_id", F.round(T.overlap_coefficient(F.col("a"), F.col("b")), 6).alias("coefficient"), F.round(T.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))
