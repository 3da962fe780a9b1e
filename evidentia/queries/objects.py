"""Queries of page objects, packets, prompts and hybrid scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hybrid, objects as O, prompts as P
from ..session import staged, table
from .fixtures import SQL_LINES, lines, papers

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A page for every order: a block for each line.
_BLOCK = """CASE l_linenumber % 7 WHEN 0 THEN concat('Algorithm ', l_suppkey % 9, '. Input: x') WHEN 1 THEN concat('so that a = b + ', l_quantity::INT, '  (', l_suppkey % 5, ')') WHEN 2 THEN concat('Figure ', l_suppkey % 4, ': ours') WHEN 3 THEN concat('as Figure 7 and Figure ', l_suppkey % 4, ' show') WHEN 4 THEN concat('Table ', l_suppkey % 3, ': all') WHEN 5 THEN 'x_1 = y_2 + z_3' ELSE concat('plain words (', l_suppkey % 5, ')') END"""


def blocks(spark, sf_dir):
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("at"), F.expr(_BLOCK.replace("l_quantity::INT", "cast(l_quantity as int)")).alias("text"),
        F.lit(10.0).alias("x0"), (F.col("l_linenumber") * 100.0).alias("y0"), F.lit(300.0).alias("x1"), (F.col("l_linenumber") * 100.0 + 20).alias("y1"),
    )


_SQL_BLOCKS = f"{SQL_LINES}, b AS (SELECT l_orderkey AS paper_id, l_linenumber AS pos, l_suppkey, l_quantity, {_BLOCK} AS text, l_linenumber * 100e0 AS y0 FROM lines)"


@_query(f"""
WITH {_SQL_BLOCKS}, own AS (SELECT paper_id, pos, CASE WHEN pos % 7 = 0 THEN 'algorithm' ELSE 'equation' END AS kind, CASE WHEN pos % 7 = 0 THEN 'Algorithm ' || (l_suppkey % 9) ELSE 'Equation ' || (l_suppkey % 5) END AS label FROM b WHERE pos % 7 IN (0, 1)),
n AS (SELECT paper_id, min(pos) AS pos FROM b WHERE pos % 7 = 5 GROUP BY paper_id) SELECT paper_id, 1 AS page, kind, label, pos AS "at", 'block' AS rule FROM own
UNION ALL SELECT paper_id, 1, 'equation', 'Equation 0', pos, 'line_level_math_fallback' FROM n WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.paper_id = n.paper_id AND own.label = 'Equation 0')""")
def page_equations(spark, sf_dir):
    b = staged(blocks(spark, sf_dir), "blocks")
    return O.equations(b, b)


@_query(f"""
WITH {_SQL_BLOCKS}, c AS (SELECT paper_id, pos, 'Figure ' || (l_suppkey % 4) AS label, y0 + 10 AS cy FROM b WHERE pos % 7 = 2), v AS (SELECT paper_id, pos AS visual, y0 - 70 AS v0, y0 - 10 AS v1, y0 - 40 AS vy FROM b WHERE l_suppkey % 2 = 0),
j AS (SELECT c.*, v.* EXCLUDE (paper_id) FROM c JOIN v USING (paper_id) WHERE abs(vy - cy) <= 0.45e0 * 842), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY abs(vy - cy), visual) AS rn FROM j), a AS (SELECT paper_id, v0 AS a0, v1 AS a1, vy AS ay FROM r WHERE rn = 1),
f AS (SELECT paper_id, min(v0) AS y0, max(v1) AS y1, count(*) AS parts FROM r JOIN a USING (paper_id) WHERE abs(vy - ay) <= 0.18e0 * 842 OR greatest(0, greatest(a0, v0) - least(a1, v1)) <= 45 GROUP BY paper_id),
m AS (SELECT paper_id, pos, unnest(['Figure 7', 'Figure ' || (l_suppkey % 4)]) AS label FROM b WHERE pos % 7 = 3)
SELECT paper_id, label, pos AS "at", y0, y1, coalesce(parts, 0) AS parts, 'caption_nearest_visual' AS rule FROM c LEFT JOIN f USING (paper_id)
UNION ALL SELECT paper_id, label, min(pos), NULL, NULL, 0, 'figure_mention_fallback' FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.paper_id = m.paper_id AND c.label = m.label) GROUP BY paper_id, label""")
def page_figures(spark, sf_dir):
    b = blocks(spark, sf_dir)
    v = lines(spark, sf_dir).where("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("visual_id"), F.lit(10.0).alias("x0"), (F.col("l_linenumber") * 100.0 - 70).alias("y0"), F.lit(300.0).alias("x1"), (F.col("l_linenumber") * 100.0 - 10).alias("y1"))
    return O.figures(b, v).select("paper_id", "label", "at", "y0", "y1", "parts", "rule")


#: Captions and regions all over the page of every order, several of each, beside and over one another.
_PLACES = """{lines}, p AS (SELECT l_orderkey AS paper_id, l_linenumber AS pos, l_partkey, l_suppkey, l_quantity, (l_suppkey % 3) * 150e0 AS cx0, l_linenumber * 60e0 + l_quantity AS cy0, (l_partkey % 4) * 120e0 AS rx0, (l_partkey % 9) * 50e0 AS ry0 FROM lines)"""


@_query(f"""
WITH {_PLACES.format(lines=SQL_LINES)}, c AS (SELECT paper_id, pos, 'Table ' || (l_suppkey % 3) AS label, cx0 + 50 AS cx, cy0 AS c0, cy0 + 12 AS c1 FROM p WHERE l_suppkey % 2 = 0),
r AS (SELECT paper_id, pos AS region_id, CASE WHEN l_suppkey % 5 < 3 THEN 'grid' ELSE 'aligned' END AS kind, rx0 + 80 AS rx, ry0 AS y0, ry0 + 15 + l_quantity AS y1 FROM p WHERE CASE WHEN l_suppkey % 5 < 3 THEN l_partkey % 5 >= 2 AND 15 + l_quantity >= 20 ELSE l_partkey % 5 >= 3 END),
j AS (SELECT r.*, c.label, c.pos, row_number() OVER (PARTITION BY r.paper_id, region_id ORDER BY least(abs(c1 - y0), abs(c0 - y1)) + 0.08e0 * abs(rx - cx), pos) AS i FROM r LEFT JOIN c ON c.paper_id = r.paper_id AND least(abs(c1 - y0), abs(c0 - y1)) <= 90),
k AS (SELECT *, row_number() OVER (PARTITION BY paper_id, label ORDER BY kind <> 'grid', y0, region_id) AS n FROM j WHERE i = 1) SELECT paper_id, 1 AS page, region_id, label, pos AS caption_at, kind FROM k WHERE label IS NULL OR n = 1""")
def page_tables(spark, sf_dir):
    p, n = lines(spark, sf_dir), F.col("l_linenumber")
    name, page = F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page")
    x, y = (F.col("l_suppkey") % 3) * 150.0, n * 60.0 + F.col("l_quantity")
    captions = p.where("l_suppkey % 2 = 0").select(name, page, n.alias("at"), F.concat(F.lit("Table "), F.col("l_suppkey") % 3, F.lit(": all")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 12).alias("y1"))
    x, y = (F.col("l_partkey") % 4) * 120.0, (F.col("l_partkey") % 9) * 50.0
    regions = p.select(name, page, n.alias("region_id"), F.when(F.col("l_suppkey") % 5 < 3, "grid").otherwise("aligned").alias("kind"), (F.col("l_partkey") % 5).alias("rows"), x.alias("x0"), y.alias("y0"), (x + 160).alias("x1"), (y + 15 + F.col("l_quantity")).alias("y1"))
    return O.tables(captions, regions)


@_query(f"""
WITH {SQL_LINES}, p AS (SELECT l_orderkey AS query_id, l_linenumber % 3 AS place, l_linenumber % 3 + 100 AS package_id, l_linenumber AS position, l_suppkey % 4 AS record_id FROM lines), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, record_id ORDER BY place, position) AS i FROM p),
s AS (SELECT query_id, place, package_id, record_id % 2 AS section_id, min(position) AS first, count(*) AS records FROM f WHERE i = 1 GROUP BY ALL)
SELECT query_id, package_id || '::s' || printf('%02d', row_number() OVER (PARTITION BY query_id, place, package_id ORDER BY first) - 1) AS chunk_ref, package_id, 'p' AS paper_id, section_id, records::INT AS records FROM s""")
def package_packets(spark, sf_dir):
    l = lines(spark, sf_dir)
    packages = l.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") % 3).alias("place"), (F.col("l_linenumber") % 3 + 100).alias("package_id"), F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 4).alias("record_id"))
    records = packages.select("query_id", "record_id").distinct().select("query_id", "record_id", F.lit("p").alias("paper_id"), (F.col("record_id") % 2).alias("section_id"), F.lit("t").alias("text"))
    return P.packets(packages, records).withColumn("records", F.size("records"))


@_query(f"""
WITH {SQL_LINES}, r AS (SELECT l_orderkey AS query_id, l_linenumber AS place, l_quantity::INT * 10 AS chars FROM lines), u AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY place) AS upto FROM r), b AS (SELECT o_orderkey AS query_id, o_custkey % 700 AS base FROM orders),
c AS (SELECT query_id, count(*) AS cards, max(upto) AS used FROM u JOIN b USING (query_id) WHERE place <= 4 AND upto <= 1000 - base GROUP BY query_id), d AS (SELECT b.*, coalesce(cards, 0) AS cards, coalesce(used, 0) AS used FROM b LEFT JOIN c USING (query_id)),
w AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY place) AS more FROM r WHERE place > 4), m AS (SELECT query_id, count(*) AS micro, max(more) AS more FROM w JOIN d USING (query_id) WHERE more + used <= 1000 - base GROUP BY query_id)
SELECT query_id, cards, coalesce(micro, 0) AS micro, (base + used + coalesce(more, 0))::BIGINT AS chars FROM d LEFT JOIN m USING (query_id)""")
def fitted_prompt(spark, sf_dir):
    rows = lines(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("place"), (F.col("l_quantity").cast("int") * 10).alias("chars"))
    fixed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 700).alias("chars"))
    return P.fitted(rows.where("place <= 4"), rows.where("place > 4"), fixed, 1000)


@_query(f"""
WITH {SQL_LINES}, e AS (SELECT l_orderkey AS query_id, string_agg('{{"evidence_ref":"E' || l_linenumber || '","text":"' || l_mode || '"}}', ',' ORDER BY l_linenumber) AS e FROM lines GROUP BY 1)
SELECT o_orderkey AS query_id, 'system' AS first, '{{"question":"' || o_orderpriority || '?","contract":{{"answer_types":["table"]}},"candidates":[{{"paper_id":' || o_custkey || ',"title":"' || o_orderstatus || '"}}],"evidence":[' || coalesce(e, '') || ']}}' AS content FROM orders LEFT JOIN e ON query_id = o_orderkey""")
def answer_prompt(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    q = o.select(F.col("o_orderkey").alias("query_id"), F.concat("o_orderpriority", F.lit("?")).alias("question"), F.array(F.lit("table")).alias("answer_types"))
    c = o.select(F.col("o_orderkey").alias("query_id"), F.lit(1).alias("rank"), F.col("o_custkey").alias("paper_id"), F.col("o_orderstatus").alias("title"))
    e = lines(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("place"), F.concat(F.lit("E"), "l_linenumber").alias("evidence_ref"), F.col("l_mode").alias("text"))
    return P.messages(q, c, e).select("query_id", F.col("messages")[0]["role"].alias("first"), F.col("messages")[1]["content"].alias("content"))


def hybrid_questions(spark, sf_dir):
    """The benchmark's questions, each naming a venue, a year and a quoted word."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("ICML 202"), F.col("item_id") % 4, F.lit(" on '"), F.element_at(F.split("text", " "), -1), F.lit("' and "), "text").alias("question"))


def hybrid_papers(spark, sf_dir):
    venue = F.element_at(F.array(*[F.lit(v) for v in ("ICML", "ACL", "CVPR")]), (F.col("paper_id") % 3 + 1).cast("int"))
    return papers(spark, sf_dir).withColumn("venue", venue).withColumn("year", F.concat(F.lit("202"), (F.col("paper_id") % 4).cast("string")))


@_query()
def hybrid_retrieval(spark, sf_dir):
    """Held against plain Python in tests/test_hybrid.py; four BM25 corpora and the boosts make too long a query."""
    return hybrid.hybrid_scores(hybrid_papers(spark, sf_dir), hybrid_questions(spark, sf_dir), 10)


def hybrid_units(spark, sf_dir):
    """Conversations as papers: turns are units of sections named by their first turn; the question is the last turn with a table's number."""
    t = table(spark, sf_dir, "conversations")
    title = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("section_title"), F.max_by("text", "turn").alias("question"))
    kind = F.when(F.col("turn") % 3 == 0, "table").otherwise("text_span")
    units = t.join(title, "conv_id").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("unit_id"), kind.alias("unit_type"), "section_title", F.concat(F.lit("Table "), "turn", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return units, title.select(F.col("conv_id").alias("query_id"), F.concat(F.lit("BERT-X in Table 2: "), F.coalesce("question", F.lit(""))).alias("question"))


@_query()
def unit_scores(spark, sf_dir):
    """Held against plain Python in tests/test_hybrid.py."""
    return hybrid.unit_scores(*hybrid_units(spark, sf_dir))
