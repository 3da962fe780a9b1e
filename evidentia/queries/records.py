"""Queries over ordered records: sections, neighbours, runs, references, selection, sets, graph and tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import html as H, text as T
from ..operators import coverage as C, joins as J, scoring as S, sections as X, selection as Y
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


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_SECTIONS = """
WITH s AS (SELECT conv_id, turn, role, length(text) AS n, sum((role = 'user')::INT) OVER w AS section_no, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w, 'front matter') AS section_title
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
"""


def _sections(spark, sf_dir):
    return X.sections(_turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "user", F.col("text"))


@_query(_SECTIONS + "SELECT conv_id, turn, section_no::BIGINT AS section_no, sha256(section_title) AS section_title FROM s")
def section_ffill(spark, sf_dir):
    """Whole titles, as digests."""
    return _sections(spark, sf_dir).select("conv_id", "turn", "section_no", F.sha2("section_title", 256).alias("section_title"))


@_query(_SECTIONS + "SELECT conv_id, section_no::BIGINT AS section_no, sha256(any_value(section_title)) AS section_title, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_records, count(*) FILTER (WHERE role = 'assistant') AS n_assistant, sum(n)::BIGINT AS chars FROM s GROUP BY conv_id, section_no")
def section_rollup(spark, sf_dir):
    """Whole titles, as digests."""
    return _rollup(_sections(spark, sf_dir)).withColumn("section_title", F.sha2("section_title", 256))


def _rollup(sections):
    return sections.groupBy("conv_id", "section_no").agg(F.first("section_title").alias("section_title"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n_records"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.sum(F.length("text")).alias("chars"))


@_query("""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT a.conv_id, a.turn, coalesce((SELECT string_agg(b.turn::VARCHAR, ',' ORDER BY b.k) FROM t b WHERE b.conv_id = a.conv_id AND b.k <> a.k AND abs(b.k - a.k) <= 2), '') AS around FROM t a""")
def neighbors_window(spark, sf_dir):
    rows = X.neighbours(_turns(spark, sf_dir), "conv_id", "turn", "turn", 2)
    return rows.select("conv_id", "turn", F.array_join(F.transform("around", lambda x: x.cast("string")), ",").alias("around"))


@_query("""
WITH p AS (SELECT a.conv_id, a.turn AS anchor, b.turn, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY abs(a.turn - b.turn), b.turn) AS place FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn WHERE a.role = 'assistant')
SELECT * FROM p WHERE place <= 2""")
def neighbors_k(spark, sf_dir):
    t = _turns(spark, sf_dir).select("conv_id", "turn", F.col("turn").alias("at"), "role")
    return X.nearest(t.where("role = 'assistant'"), t, "conv_id", "at", "turn", 2)


@_query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), h AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e WHERE value > 5e0)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM h GROUP BY user_id, island HAVING count(*) >= 3""")
def gaps_islands_runs(spark, sf_dir):
    return X.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 5.0, 3)


_ENTRY = "CASE WHEN l_linenumber = 1 THEN 'References' WHEN l_linenumber % 4 = 2 THEN concat('[', l_linenumber * 2, '] Author of part ', l_partkey, ' in press') WHEN l_linenumber % 4 = 3 THEN concat('and continued with part ', l_partkey) WHEN l_linenumber % 4 = 0 THEN concat('Someone else on part ', l_partkey, ' again') ELSE 'short' END"


@_query(f"""
WITH r AS (SELECT l_orderkey AS k, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS pos, {_ENTRY} AS text FROM lineitem), a AS (SELECT *, max(CASE WHEN text = 'References' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS on_ FROM r),
p AS (SELECT *, try_cast(nullif(regexp_extract(text, '^\\s*\\[(\\d{{1,4}})\\]', 1), '') AS BIGINT) AS printed, row_number() OVER (PARTITION BY k ORDER BY pos) AS rn FROM a WHERE on_ = 1 AND text <> 'References' AND length(text) >= 20),
m AS (SELECT *, sum((NOT (printed IS NULL AND rn > 1 AND regexp_matches(text, '^\\s*[a-z,;:)\\]]')))::INT) OVER (PARTITION BY k ORDER BY pos) AS entry FROM p),
e AS (SELECT k, entry, max(printed) AS printed, string_agg(text, ' ' ORDER BY pos) AS text FROM m GROUP BY k, entry),
l AS (SELECT *, last_value(CASE WHEN printed IS NOT NULL THEN entry END IGNORE NULLS) OVER w AS le, last_value(printed IGNORE NULLS) OVER w AS lp FROM e WINDOW w AS (PARTITION BY k ORDER BY entry ROWS UNBOUNDED PRECEDING))
SELECT k, coalesce(lp + entry - le, entry)::BIGINT AS number, text FROM l""")
def reference_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("pos"), F.when(F.col("l_linenumber") == 1, "heading").otherwise("paragraph").alias("kind"), F.expr(_ENTRY).alias("text"))
    return X.references(rows, "k", "pos")


@_query("SELECT source, lang, doc_id, length(text)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def record_dedupe_longest(spark, sf_dir):
    return Y.first_by(table(spark, sf_dir, "documents"), ["source", "lang"], F.desc(F.length("text")), F.asc("doc_id")).select("source", "lang", "doc_id", F.length("text").cast("long").alias("n"))


@_query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_occurrence_distinct(spark, sf_dir):
    return Y.first_by(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], F.asc("event_id"))


@_query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_by_query(spark, sf_dir):
    return Y.first_by(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], F.desc("event_id"))


@_query("SELECT h, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM (SELECT sha256(concat_ws('|', lang, text)) AS h, source, doc_id FROM documents) GROUP BY h HAVING count(*) > 1")
def content_hash_conflicts(spark, sf_dir):
    return J.repeated_contents(table(spark, sf_dir, "documents"), ["lang", "text"], "source", "doc_id")


_SIZED = "SELECT source AS k, doc_id, length(text) AS n, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents"


def _sized(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("k"), "doc_id", F.length("text").cast("long").alias("n"), "lang", "n_chars")
    return rows.withColumn("rank", S.rank_by(["k"], F.desc("n_chars"), F.asc("doc_id"))).drop("n_chars")


@_query(f"WITH s AS ({_SIZED}), r AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY k) > 40000 AS truncated FROM s) SELECT k, doc_id, truncated FROM r WHERE upto <= 40000 OR rank = 1")
def char_budget_prefix(spark, sf_dir):
    return Y.char_prefix(_sized(spark, sf_dir), ["k"], "n", 40_000, F.asc("rank")).select("k", "doc_id", "truncated")


@_query(f"WITH s AS ({_SIZED}), r AS (SELECT *, row_number() OVER (PARTITION BY k, lang ORDER BY rank) > 2 AS late FROM s), p AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY late, rank) AS place FROM r) SELECT * FROM p WHERE place <= 12")
def type_budget_quota(spark, sf_dir):
    return Y.type_quota(_sized(spark, sf_dir), ["k"], "lang", 2, 12, F.asc("rank")).select("k", "doc_id", "place")


@_query(f"WITH s AS ({_SIZED}), r AS (SELECT *, lang = 'de' AS own, row_number() OVER (PARTITION BY k, lang = 'de' ORDER BY rank) AS o, least(3, count(*) FILTER (WHERE lang = 'de') OVER (PARTITION BY k)) AS q FROM s), p AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN own AND o <= q THEN 0 ELSE 1 END, rank) AS place FROM r) SELECT k, doc_id FROM p WHERE place <= 6")
def routing_top1_quota(spark, sf_dir):
    return Y.top1_quota(_sized(spark, sf_dir).withColumn("own", F.col("lang") == "de"), ["k"], "own", 3, 6).select("k", "doc_id")


@_query(f"WITH s AS ({_SIZED}), p AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY lang = 'fr' DESC, rank) AS place FROM s) SELECT * FROM p WHERE place <= 6")
def routing_top1_first(spark, sf_dir):
    rows = _sized(spark, sf_dir).withColumn("place", S.rank_by(["k"], F.desc(F.col("lang") == "fr"), F.asc("rank")))
    return rows.where("place <= 6").select("k", "doc_id", "place")


@_query(f"WITH s AS ({_SIZED}), r AS (SELECT *, row_number() OVER (PARTITION BY k, lang ORDER BY rank) > 1 AS late FROM s), p AS (SELECT k, doc_id, row_number() OVER (PARTITION BY k ORDER BY late, rank) AS place FROM r) SELECT * FROM p WHERE place <= 8")
def routing_best_per_member(spark, sf_dir):
    return Y.best_per_then_global(_sized(spark, sf_dir), ["k"], "lang", 8).select("k", "doc_id", "place")


@_query()
def skip_budget(spark, sf_dir):
    return Y.skip_budget(_sized(spark, sf_dir), "k", "doc_id", "n", 20_000, "rank", overhead=200)


@_query()
def greedy_package_select(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("package_id"), F.col("l_partkey").alias("paper_id"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("kind"), F.col("l_discount").alias("score"), (F.col("l_quantity") * 100).cast("long").alias("size"))
    return Y.greedy_packages(rows, "l_suppkey")


@_query()
def unit_packing(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.col("turn").alias("record_id"), "text")
    return X.pack_units(rows, "conv_id", "turn", target=60, most=90).select("conv_id", "unit", F.size("ids").alias("n_records"), "n_tokens")


# the parts of each supplier's lines and the orders in which they stand
_SETS = "SELECT l_suppkey AS k, l_partkey AS member, list_sort(list(DISTINCT l_orderkey)) AS items FROM lineitem GROUP BY ALL"


def _sets(spark, sf_dir):
    return C.coverage_sets(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("member"), "l_orderkey"), "k", "member", "l_orderkey")


@_query(f"WITH m AS ({_SETS}) SELECT k, member, sha256(array_to_string(items, ',')) AS items_sha256, len(items)::INT AS covered FROM m")
def coverage_bitmask(spark, sf_dir):
    return _sets(spark, sf_dir).select("k", "member", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.size("items").alias("covered"))


_UNDOMINATED = f"""WITH m AS ({_SETS}), o AS (SELECT k, items, min(member) AS member FROM m GROUP BY ALL), e AS (SELECT k, member, unnest(items) AS x, len(items) AS n FROM o),
lost AS (SELECT a.k, a.member FROM e a JOIN e b ON a.k = b.k AND a.x = b.x AND b.n > a.n GROUP BY a.k, a.member, b.member, a.n HAVING count(*) = a.n), u AS (SELECT * FROM o ANTI JOIN lost USING (k, member))"""


@_query(f"{_UNDOMINATED} SELECT k, member, sha256(array_to_string(items, ',')) AS items_sha256 FROM u")
def dominated_mask_antijoin(spark, sf_dir):
    return C.undominated(_sets(spark, sf_dir), "k", "member").select("k", "member", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))


@_query(f"""{_UNDOMINATED}, w AS (SELECT k, member, unnest(items) AS x, len(items) AS n FROM u), c AS (SELECT a.k, a.member AS a, b.member AS b, count(*) AS n FROM w a JOIN w b ON a.k = b.k AND a.x = b.x AND a.member <= b.member GROUP BY ALL)
SELECT a.k, max(len(a.items) + len(b.items) - coalesce(c.n, 0))::BIGINT AS covered FROM u a JOIN u b ON a.k = b.k AND a.member <= b.member LEFT JOIN c ON c.k = a.k AND c.a = a.member AND c.b = b.member GROUP BY a.k""")
def max_coverage_dp(spark, sf_dir):
    return C.max_coverage(_sets(spark, sf_dir), "k", "member", 2).select("k", "covered")


@_query()
def greedy_coverage(spark, sf_dir):
    return C.greedy_coverage(_sets(spark, sf_dir).withColumn("page", F.col("member") % 5), "k", "member", 3, 1)


@_query(f"""
WITH {SQL_LINES}, o AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS page, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE l_mode END AS label, l_partkey % 2 = 0 AS caption FROM lines),
c AS (SELECT a.l_orderkey, a.l_linenumber AS src, b.l_linenumber AS dst, a.label = b.label AS same, bool_or(a.label = b.label) OVER w AS anysame, row_number() OVER (w ORDER BY abs(a.l_linenumber - b.l_linenumber), b.l_linenumber) AS n FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.page = b.page AND a.caption AND NOT b.caption WINDOW w AS (PARTITION BY a.l_orderkey, a.page, a.l_linenumber))
SELECT 'same_label' AS type, a.l_orderkey * 10 + a.l_linenumber AS src, a.l_orderkey * 10 + b.l_linenumber AS dst FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.label = b.label AND a.label <> '' AND a.l_linenumber <> b.l_linenumber
UNION ALL SELECT 'caption_of', l_orderkey * 10 + src, l_orderkey * 10 + dst FROM c WHERE CASE WHEN anysame THEN same ELSE n = 1 END""")
def graph_edges(spark, sf_dir):
    o = lines(spark, sf_dir).select("l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node"), (F.col("l_suppkey") % 3).alias("page"), F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.col("l_mode")).alias("label"), "l_linenumber", (F.col("l_partkey") % 2 == 0).alias("caption"))
    return J.label_edges(o, "l_orderkey", "node", "label").unionByName(J.caption_edges(o.where("caption"), o.where("not caption"), "l_orderkey", "page", "node", "label", "l_linenumber"))


@_query("SELECT o_custkey AS claim, count(DISTINCT l_orderkey || '-' || l_linenumber) AS records, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS keys FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def claim_key_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("claim")).agg(F.countDistinct("l_orderkey", "l_linenumber").alias("records"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("keys"))


@_query("""
WITH k AS (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, * FROM orders) SELECT o_custkey, o_orderkey, printf('E%04d', n) AS evidence_ref, printf('%s::p%03d_r%04d', o_orderpriority, n % 50, n) AS record_id FROM k""")
def opaque_keys(spark, sf_dir):
    n = S.rank_by(["o_custkey"], F.asc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("n", n)
    return rows.select("o_custkey", "o_orderkey", F.format_string("E%04d", "n").alias("evidence_ref"), F.format_string("%s::p%03d_r%04d", F.col("o_orderpriority"), F.col("n") % 50, F.col("n")).alias("record_id"))


_BOX = "l_orderkey, l_linenumber, l_partkey % 100 AS x0, l_partkey % 100 + 10 AS x1, l_suppkey % 100 AS y0, l_suppkey % 100 + 5 AS y1"


@_query(f"""
WITH b AS (SELECT {_BOX} FROM lineitem) SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, greatest(0, greatest(a.y0 - b.y1, b.y0 - a.y1)) + 0.25e0 * greatest(0, greatest(a.x0 - b.x1, b.x0 - a.x1)) AS distance,
  a.x0 - 2 < b.x1 AND b.x0 - 2 < a.x1 AND a.y0 - 2 < b.y1 AND b.y0 - 2 < a.y1 AS touching FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def box_distance(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").selectExpr(*[x.strip().replace(" AS ", " as ") for x in _BOX.split(", ")])
    a = b.toDF(*[c if c == "l_orderkey" else f"a_{c}" for c in b.columns])
    pairs = a.join(b, "l_orderkey").where("a_l_linenumber < l_linenumber")
    return pairs.select("l_orderkey", F.col("a_l_linenumber").alias("i"), F.col("l_linenumber").alias("j"), J.box_distance("a_", "").alias("distance"), J.boxes_touch("a_", "").alias("touching"))


@_query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, line, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS cells FROM l WHERE contains(line, '|')),
w AS (SELECT doc_id, len(cells) AS width, count(*) AS n FROM c GROUP BY ALL)
SELECT doc_id, (SELECT width FROM w b WHERE b.doc_id = a.doc_id ORDER BY n DESC, width DESC LIMIT 1)::INT AS width, sum(n)::BIGINT AS n_rows, sum(n * width)::BIGINT AS n_cells FROM w a GROUP BY doc_id""")
def pipe_tables(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("|"))
    w = lines.select("doc_id", F.size(H.pipe_cells(F.col("line"))).alias("width")).groupBy("doc_id", "width").agg(F.count("*").alias("n"))
    return w.groupBy("doc_id").agg(F.max(F.struct("n", "width"))["width"].alias("width"), F.sum("n").alias("n_rows"), F.sum(F.col("n") * F.col("width")).alias("n_cells"))


@_query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS r FROM documents), c AS (SELECT doc_id, r, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS cells FROM l WHERE contains(line, '|')),
u AS (SELECT doc_id, r, unnest(cells) AS value, generate_subscripts(cells, 1) AS k FROM c) SELECT doc_id, (r - 1)::INT AS row_index, (k - 1)::INT AS column_index, value FROM u""")
def table_cells(spark, sf_dir):
    return _pipe_lines(spark, sf_dir).select("doc_id", "row_index", F.posexplode(H.pipe_cells(F.col("line"))).alias("column_index", "value"))


def _pipe_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_index", "line")).where(F.col("line").contains("|"))


@_query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)))::INT AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.pdf$|/pdf') AS direct_pdf FROM pages")
def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.array_distinct(H.links(F.col("html")))).alias("n_links"), H.title(F.col("html")).alias("title"), H.host(F.col("url")).alias("host"), H.is_direct_pdf(F.col("url")).alias("direct_pdf"))


_URLS = "CASE page_id % 6 WHEN 0 THEN 'https://arxiv.org/pdf/2401.0' || (10000 + page_id) || 'v2.pdf' WHEN 1 THEN 'https://doi.org/10.1234/abc.' || page_id WHEN 2 THEN url WHEN 3 THEN 'https://openreview.net/forum?id=ab_' || page_id || 'xyz' WHEN 4 THEN url || '/paper.pdf' ELSE 'see 10.5555/x' || page_id END"


@_query(f"""
WITH u AS (SELECT page_id, {_URLS} AS u FROM pages) SELECT page_id, nullif(regexp_extract(u, '(?i)arxiv\\.org/(?:abs|pdf)/(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1), '') AS arxiv_id, nullif(regexp_extract(u, '\\b(10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+)\\b', 1), '') AS doi, nullif(regexp_extract(u, 'openreview\\.net/[^?]*\\?.*?id=([A-Za-z0-9_-]+)', 1), '') AS forum_id,
  CASE WHEN contains(lower(u), 'arxiv.org') THEN 2 WHEN contains(lower(u), 'openreview.net') THEN 3 WHEN contains(lower(u), 'doi.org') THEN 4 WHEN regexp_matches(lower(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.pdf$|/pdf') THEN 1 WHEN regexp_matches(u, '^https?://') THEN 5 ELSE 9 END AS priority FROM u""")
def pdf_url_priority(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_URLS).alias("u"))
    ids = H.identifiers(F.col("u"))
    return rows.select("page_id", *[ids[c].alias(c) for c in ("arxiv_id", "doi", "forum_id")], H.url_priority(F.col("u")).alias("priority"))


@_query("SELECT page_id, count(*) AS n_elements, count(*) FILTER (WHERE tag IN ('h1', 'h2', 'h3')) AS n_headings, count(*) FILTER (WHERE tag = 'p') AS n_paragraphs FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-3]|p|li|td|th)[ >]', 1)) AS tag FROM pages) GROUP BY page_id")
def page_elements(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(H.block_tags(F.col("html"))).alias("tag"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n_elements"), F.count_if(F.col("tag").isin("h1", "h2", "h3")).alias("n_headings"), F.count_if(F.col("tag") == "p").alias("n_paragraphs"))


@_query("""
WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2)) AS t FROM benchmark), s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents),
f AS (SELECT item_id, doc_id, s, len(list_intersect(t, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')))) AS hits FROM q, s)
SELECT item_id, doc_id, hits::INT AS hits, s AS fragment, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, length(s), doc_id, s) AS place FROM f WHERE hits > 0) WHERE place <= 3""")
def extractive_fragments(spark, sf_dir):
    """Every question over all documents."""
    return _fragments(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


#: How many of a question's rarest words tell how good its best sentences are at least.
SEEDS = 3


def _fragments(questions, documents, k=3):
    """The k sentences with most of a question's words; only those that can be among them are compared, and texts are never shuffled.

    The k-th best of the sentences with one of a question's SEEDS rarest words has `least` of its words; whatever has as many holds one of all
    its words but the least - 1 most frequent ones, and is looked at where it holds the rarest of these that it has.
    """
    s = staged(documents.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).withColumn("words", T.content_tokens(F.col("s"))).where(F.size("words") > 0), "sentences")
    q = questions.select("item_id", T.content_tokens(F.col("text")).alias("t"))
    asked = staged(q.select(F.explode("t").alias("term")).distinct(), "asked")
    held = lambda terms: s.withColumn("term", F.explode("words")).join(terms, "term")
    df = staged(held(asked).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    of = q.withColumn("row", F.monotonically_increasing_id()).select("row", "item_id", F.explode("t").alias("term")).join(df, "term").groupBy("row", "item_id")
    rare = staged(of.agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("_t")).select("row", "item_id", F.transform("_t", lambda x: x["term"]).alias("t")), "rare")

    def met(first):  # rare with `pre`, the words that a sentence must hold one of: every pair of these once
        rows = held(staged(first.withColumn("term", F.explode("pre")), "first")).where(F.get(F.array_intersect("pre", "words"), F.lit(0)) == F.col("term"))
        return rows.withColumn("hits", F.size(F.array_intersect("t", "words")))

    seeds = met(rare.withColumn("least", F.lit(1)).withColumn("pre", F.slice("t", 1, SEEDS))).withColumn("_i", F.row_number().over(W.partitionBy("row").orderBy(F.desc("hits")))).where(F.col("_i") <= k)
    least = seeds.groupBy("row").agg(F.when(F.count("*") >= k, F.min("hits")).otherwise(1).alias("least"))
    rows = met(rare.join(least, "row").withColumn("pre", F.expr("slice(t, 1, size(t) - least + 1)"))).where(F.col("hits") >= F.col("least"))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("hits"), F.length("s"), "doc_id", "s")).cast("long")).where(F.col("place") <= k)
    return rows.select("item_id", "doc_id", "hits", F.col("s").alias("fragment"), "place")
