"""Queries of standardised documents and selected packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import standardizer as Z
from .fixtures import SQL_LINES, lines

QUERIES, SQL = {}, {}

#: Elements of a document for every order: tables, pictures, formulas, code, captions, prose with mentions, and a reference list.
_TYPE = "CASE l_partkey % 8 WHEN 0 THEN 'table' WHEN 1 THEN 'picture' WHEN 2 THEN 'formula' WHEN 3 THEN 'code' WHEN 4 THEN 'caption' ELSE 'text' END"
_TEXT = """CASE l_partkey % 8 WHEN 0 THEN concat('Table ', l_suppkey % 3, '. x | y') WHEN 1 THEN concat('Fig. ', l_suppkey % 4, '(a)') WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'E = mc' ELSE 'x = y (Eq. (4))' END
 WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Algorithm 1: loop' ELSE 'for x in y' END WHEN 4 THEN concat(CASE WHEN l_suppkey % 2 = 0 THEN 'Table ' ELSE 'Figure ' END, CAST(l_quantity AS INT) % 4, ': a caption')
 WHEN 5 THEN CASE l_suppkey % 4 WHEN 0 THEN 'References' WHEN 1 THEN 'Introduction' WHEN 2 THEN ' ' ELSE 'As Eq. (7) and Equation 9. say: log x = alpha.' END
 WHEN 6 THEN CASE l_suppkey % 3 WHEN 0 THEN concat('[', CAST(l_quantity AS INT), '] A. Author, a title, 2020.') WHEN 1 THEN 'continued on the next column of it' ELSE 'Too short' END ELSE CASE l_suppkey % 5 WHEN 0 THEN 'Bibliography' ELSE 'B. Author, another title, 2021.' END END"""


def elements(spark, sf_dir):
    kind = F.expr(_TYPE)
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").cast("long").alias("at"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 2).cast("long").alias("page"), kind.alias("element_type"), kind.alias("backend_type"), F.lit(None).cast("string").alias("label"), F.expr(_TEXT).alias("text"))


_RECORDS = rf"""
WITH {SQL_LINES}, e AS (SELECT l_orderkey AS paper, l_linenumber AS nr, CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 2 END AS page, {_TYPE} AS raw, trim({_TEXT}) AS text FROM lines),
k AS (SELECT *, CASE WHEN raw = 'table' THEN 'table' WHEN raw = 'picture' THEN 'figure' WHEN raw = 'formula' THEN 'equation' WHEN raw = 'code' AND text LIKE 'Algorithm%' THEN 'algorithm' WHEN text IN ('References', 'Introduction', 'Bibliography') THEN 'section_header' ELSE 'paragraph' END AS kind FROM e WHERE text <> ''),
t AS (SELECT *, CASE kind WHEN 'table' THEN regexp_extract(text, 'Table \d') WHEN 'figure' THEN 'Figure ' || regexp_extract(text, 'Fig\. (\d\(a\))', 1) WHEN 'equation' THEN CASE WHEN contains(text, 'Eq.') THEN 'Equation 4' ELSE 'Equation 0' END WHEN 'algorithm' THEN 'Algorithm 1' WHEN 'section_header' THEN text END AS label FROM k),
q AS (SELECT * FROM t WHERE kind IN ('equation', 'algorithm') AND page IS NOT NULL),
z AS (SELECT paper, page, min_by(text, nr) AS text, min(nr) AS nr FROM q WHERE kind = 'equation' GROUP BY ALL HAVING count(*) FILTER (WHERE label = 'Equation 0') = 0),
m AS (SELECT paper, page, min_by(text, nr) AS text, min(nr) AS nr FROM t WHERE kind IN ('paragraph', 'section_header') AND page IS NOT NULL AND contains(text, 'log x') AND NOT EXISTS (SELECT 1 FROM q WHERE q.paper = t.paper AND q.page = t.page AND q.kind = 'equation') GROUP BY ALL),
p AS (SELECT paper, page, nr, pos, label, text FROM (SELECT paper, page, nr, text, unnest([0, 1]) AS pos, unnest(['Equation 7', 'Equation 9']) AS label FROM t WHERE contains(text, 'Equation 9') AND page IS NOT NULL) x
  WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.paper = x.paper AND q.page = x.page AND q.label = x.label) QUALIFY row_number() OVER (PARTITION BY paper, page, label ORDER BY nr, pos) = 1),
c AS (SELECT paper, page, nr, text, regexp_extract(text, '(Table|Figure) \d') AS label FROM t WHERE raw = 'caption'),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.paper = c.paper AND t.kind IN ('table', 'figure') AND t.label = c.label) QUALIFY row_number() OVER (PARTITION BY paper, label ORDER BY nr) = 1),
d AS (SELECT paper, page, 1 AS step, nr, 0 AS pos, 'equation' AS kind, 'Equation 0' AS label, '{Z.ALIAS_TEXT}' || text AS text FROM z UNION ALL SELECT paper, page, 2, nr, 0, 'equation', 'Equation 0', '{Z.MATH_TEXT}' || text FROM m
  UNION ALL SELECT paper, page, 3, nr, pos, 'equation_reference', label, label || '{Z.POINTER_TEXT}' || text FROM p UNION ALL SELECT paper, page, CASE WHEN label LIKE 'F%' THEN 4 ELSE 5 END, nr, 0, CASE WHEN label LIKE 'F%' THEN 'figure' ELSE 'table_caption' END, label, text FROM f),
n AS (SELECT paper, count(*) AS n FROM t GROUP BY paper),
h AS (SELECT *, sum((kind = 'section_header')::INT) OVER (PARTITION BY paper ORDER BY nr) AS run, coalesce(last_value(CASE WHEN kind = 'section_header' THEN text <> 'Introduction' END IGNORE NULLS) OVER (PARTITION BY paper ORDER BY nr), false) AS list FROM t),
i AS (SELECT *, list AND kind = 'paragraph' AND length(text) >= 20 AS own, nullif(regexp_extract(text, '^\[(\d+)\]', 1), '')::BIGINT AS number FROM h),
j AS (SELECT *, own AND number IS NULL AND text LIKE 'continued%' AND sum(own::INT) OVER (PARTITION BY paper, run ORDER BY nr) > 1 AS more FROM i),
l AS (SELECT *, own AND NOT more AS entry, sum((own AND number IS NOT NULL)::INT) OVER (PARTITION BY paper ORDER BY nr) AS g FROM j),
o AS (SELECT *, coalesce(max(CASE WHEN own THEN number END) OVER (PARTITION BY paper, g), 0) + sum((entry AND number IS NULL)::INT) OVER (PARTITION BY paper, g ORDER BY nr) AS num, max(CASE WHEN entry THEN nr END) OVER (PARTITION BY paper ORDER BY nr) AS owner FROM l),
x AS (SELECT paper, owner, string_agg(' ' || text, '' ORDER BY nr) AS tail FROM o WHERE more GROUP BY ALL),
r AS (SELECT o.paper, page, nr, CASE WHEN entry THEN 'reference_entry' ELSE kind END AS kind, CASE WHEN entry THEN 'Reference ' || num ELSE label END AS label, text || CASE WHEN entry THEN coalesce(tail, '') ELSE '' END AS text, NULL::BIGINT AS source_at FROM o LEFT JOIN x ON x.paper = o.paper AND x.owner = o.nr WHERE NOT more),
every AS (SELECT paper, page, nr, kind, label, text, source_at FROM r UNION ALL SELECT paper, page, n + row_number() OVER (PARTITION BY paper ORDER BY step, nr, pos), kind, label, text, nr FROM d JOIN n USING (paper))
SELECT paper AS paper_id, coalesce(page, -1)::BIGINT AS page, nr::BIGINT AS reading_order, 'p' || lpad(greatest(0, coalesce(page, -1))::VARCHAR, 3, '0') || '_r' || lpad(nr::VARCHAR, 4, '0') AS record_id, kind AS record_type,
  CASE WHEN kind IN ('equation', 'algorithm', 'equation_reference') THEN 'equation_algorithm' WHEN kind IN ('table', 'table_caption') THEN 'table' WHEN kind = 'figure' THEN 'figure' WHEN kind = 'reference_entry' THEN 'citation_context' ELSE 'text_span' END AS source_type, label, text, source_at::BIGINT AS source_at FROM every"""


def standardized_records(spark, sf_dir):
    return Z.standardized(elements(spark, sf_dir)).select("paper_id", "page", "reading_order", "record_id", "record_type", "source_type", "label", "text", "source_at")


QUERIES["standardized_records"], SQL["standardized_records"] = standardized_records, _RECORDS


def standardized_pages(spark, sf_dir):
    own = elements(spark, sf_dir)
    return Z.page_status(own, Z.standardized(own))


QUERIES["standardized_pages"] = standardized_pages
SQL["standardized_pages"] = f"""
WITH x AS ({_RECORDS}), r AS (SELECT paper_id, page, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT l_orderkey AS paper_id, -1::BIGINT AS page, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS s FROM lineitem) WHERE s % 7 = 0 GROUP BY ALL)
SELECT coalesce(r.paper_id, m.paper_id) AS paper_id, coalesce(r.page, m.page) AS page, coalesce(r.n, 0) AS n_records, coalesce(m.n, 0) AS n_missing, CASE WHEN r.n > 0 THEN 'complete' ELSE 'failed' END AS status FROM r FULL JOIN m ON r.paper_id = m.paper_id AND r.page = m.page"""
