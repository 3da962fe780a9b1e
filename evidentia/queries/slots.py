"""Queries of slot plans, routes, extracted slots, windows and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import relations as R, slots as S
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


_ROLE = "CASE l_linenumber % 5 WHEN 0 THEN 'condition' WHEN 1 THEN '' WHEN 2 THEN 'chef' ELSE 'contributor' END"
_OPERATION = "CASE l_partkey % 6 WHEN 0 THEN 'Literal' WHEN 1 THEN 'comparison' WHEN 2 THEN 'list' WHEN 3 THEN 'invent' WHEN 4 THEN '' ELSE 'count' END"
_QUESTION = "CASE o_custkey % 4 WHEN 0 THEN 'What does Table 3 say of AIR (fast lane)?' WHEN 1 THEN 'Compare the papers.' ELSE concat('Who wrote about ', o_orderpriority, '?') END"


def planned(spark, sf_dir):
    """Planned slots: every line of an order, with types by its part."""
    rows = lines(spark, sf_dir)
    types = F.when(F.col("l_suppkey") % 4 == 0, F.array(F.lit("Text"))).when(F.col("l_suppkey") % 4 == 1, F.array(F.lit("citation"), F.lit("novel"))).when(F.col("l_suppkey") % 4 == 2, F.array(F.lit("table"), F.lit("table"))).otherwise(F.array().cast("array<string>"))
    entities = F.array(F.col("l_mode"), F.lit(" "), F.col("l_mode"), F.concat(F.lit("X"), F.col("l_partkey") % 3))
    return rows.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("at"), F.expr(_ROLE).alias("role"), F.expr(_OPERATION).alias("operation"), types.alias("types"), entities.alias("entities"), F.array(F.concat(F.lit("ipc "), "l_linenumber")).alias("conditions"))


def asked(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("query_id"), F.expr(_QUESTION).alias("question"), F.array(F.lit("figure")).alias("preferred"), F.lit("direct").alias("operation"), F.array("o_orderpriority").alias("focus"), (F.col("o_custkey") % 2 == 1).alias("multi"))


_SLOTS = f"""{SQL_LINES}, q AS (SELECT o_orderkey AS query_id, {_QUESTION} AS question, o_custkey % 4 = 0 AS numbered, o_custkey % 2 = 1 AS multi, o_orderpriority FROM orders),
r AS (SELECT l_orderkey AS query_id, l_linenumber AS pos, CASE WHEN l_linenumber % 5 = 0 THEN 'condition' WHEN l_linenumber % 5 = 1 THEN 'direct_answer' ELSE 'contributor' END AS role, CASE l_partkey % 6 WHEN 0 THEN 'direct' WHEN 1 THEN 'difference' WHEN 2 THEN 'list' WHEN 4 THEN 'direct' ELSE 'count' END AS operation,
  CASE l_suppkey % 4 WHEN 0 THEN CASE WHEN numbered THEN ['table'] ELSE ['text_span'] END WHEN 1 THEN ['citation_context'] WHEN 2 THEN ['table'] ELSE ['figure'] END AS types, [l_mode, 'X' || (l_partkey % 3)] AS entities, ['ipc ' || l_linenumber] AS conditions, multi, CASE WHEN l_suppkey % 4 = 0 AND numbered THEN 'slot_source_type_explicitly_corrected' ELSE 'slot_accepted' END AS audit
  FROM lines JOIN q ON l_orderkey = query_id WHERE l_linenumber % 5 <> 2 AND l_partkey % 6 <> 3),
f AS (SELECT query_id, 1 AS pos, 'direct_answer' AS role, 'direct' AS operation, ['figure'] AS types, [o_orderpriority] AS entities, []::VARCHAR[] AS conditions, false AS multi, 'slot_plan_fallback' AS audit FROM q WHERE query_id NOT IN (SELECT query_id FROM r)),
u AS (SELECT *, multi AND operation = 'list' AND len(entities) > 1 AS split FROM (SELECT * FROM r UNION ALL SELECT * FROM f)), e AS (SELECT * EXCLUDE (entities), unnest(CASE WHEN split THEN [[entities[1]], [entities[2]]] ELSE [entities] END) AS entities, unnest(CASE WHEN split THEN [0, 1] ELSE [0] END) AS k FROM u),
p AS (SELECT query_id, printf('S%03d', row_number() OVER (PARTITION BY query_id ORDER BY pos, k)) AS slot_id, role, operation, types, entities, conditions, CASE WHEN split THEN 'cross_paper_list_slot_split' ELSE audit END AS audit, row_number() OVER (PARTITION BY query_id ORDER BY pos, k) AS n FROM e)"""


@_query(f"WITH {_SLOTS} SELECT query_id, slot_id, role, operation, types, entities, conditions, audit FROM p WHERE n <= 16")
def slot_plan(spark, sf_dir):
    return S.slot_plan(planned(spark, sf_dir), asked(spark, sf_dir))


@_query(f"""
WITH {_SLOTS}, s AS (SELECT p.*, question FROM p JOIN q USING (query_id) WHERE n <= 16), w AS (SELECT *, CASE WHEN list_contains(types, 'citation_context') THEN list_append(types, 'text_span') ELSE types END AS wider, array_to_string(list_concat(list_concat(types, entities), conditions), ' ') AS main FROM s),
a AS (SELECT query_id, slot_id, wider AS types, 0 AS k, main AS query, false AS catalog_fallback FROM w UNION ALL SELECT query_id, slot_id, wider, 1, array_to_string(types, ' ') || ' AIR fast lane', true FROM w WHERE contains(question, 'AIR (') AND list_contains(entities, 'AIR')),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY slot_id, k) AS i FROM a WHERE length(query) >= 4) SELECT query_id, slot_id, types, query, catalog_fallback FROM d WHERE i = 1""")
def slot_routes(spark, sf_dir):
    return S.slot_routes(S.slot_plan(planned(spark, sf_dir), asked(spark, sf_dir)), asked(spark, sf_dir))


_TABLE_TEXT = "concat('| Set | A | B |\\n|---|---|---|\\n| one | ', l_quantity::INT, ' | b', l_linenumber, ' |\\n| two | ', l_quantity::INT + 1, ' | b', l_suppkey, ' |\\n| absolute delta | ', CASE WHEN l_partkey % 3 = 0 THEN 'n/a' ELSE '-' || l_linenumber || '.5' END, ' | 9 |')"


@_query(f"""
WITH {SQL_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 > 0 AND l_suppkey % 2 = 0 THEN '-' || l_linenumber || '.5' END AS delta FROM lines""")
def table_delta(spark, sf_dir):
    rows = lines(spark, sf_dir)
    text = F.expr(_TABLE_TEXT.replace("::INT", "_n").replace("l_quantity_n", "cast(l_quantity as int)"))
    second = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity").cast("int") + 1).otherwise(-5)
    return rows.select("l_orderkey", "l_linenumber", S.reported_difference(text, F.col("l_quantity").cast("int").cast("string"), second.cast("string")).alias("delta"))


@_query(f"""
WITH {SQL_LINES}, v AS (SELECT DISTINCT l_orderkey AS query_id, l_quantity::INT::VARCHAR AS value FROM lines WHERE l_linenumber = 1), h AS (SELECT l.* FROM lines l JOIN v ON v.query_id = l_orderkey AND v.value = l_quantity::INT::VARCHAR WHERE l_suppkey % 5 > 0)
SELECT l_orderkey AS query_id, l_linenumber AS row, 'Model name' AS name, l_mode AS value FROM h UNION ALL SELECT l_orderkey, l_linenumber, 'Quantity sold', l_quantity::INT::VARCHAR FROM h UNION ALL SELECT l_orderkey, l_linenumber, 'Supplier', 's' || l_suppkey FROM h""")
def aligned_rows(spark, sf_dir):
    l = lines(spark, sf_dir).withColumn("query_id", F.col("l_orderkey")).withColumn("row", F.col("l_linenumber")).withColumn("label", F.when(F.col("l_suppkey") % 5 > 0, F.col("l_mode")).otherwise(""))
    q = F.col("l_quantity").cast("int").cast("string")
    held = l.select("query_id", "row", "label", F.explode(F.create_map(F.lit("quantity"), q, F.lit("SUPPLIER"), F.concat(F.lit("s"), "l_suppkey"), F.lit("other"), F.lit("x"))).alias("key", "value"))
    schema = l.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("place")) for k, n in enumerate(("Model name", "Quantity sold", "Supplier"))])).alias("s")).select("query_id", "s.*")
    return S.aligned_rows(l.where("l_linenumber = 1").select("query_id", q.alias("value")), held, schema)


@_query(f"""
WITH {SQL_LINES}, e AS (SELECT l_orderkey AS query_id, 'S' || l_linenumber AS slot_id, l_partkey % 3 AS k, l_quantity::INT AS n, l_linenumber, l_suppkey % 2 = 0 AS held, l_partkey % 5 AS typed, l_suppkey % 3 AS c FROM lines),
j AS (SELECT *, held AND typed <> 1 AS type_ok, (k = 0 OR (held AND c > 0)) AS numeric_ok FROM e)
SELECT query_id, slot_id, CASE WHEN type_ok AND numeric_ok AND n % 7 > 0 THEN 'supported' ELSE 'partial' END AS status, CASE WHEN type_ok AND numeric_ok AND n % 7 > 0 THEN CASE k WHEN 0 THEN 'a name' WHEN 1 THEN n::VARCHAR ELSE CASE WHEN typed = 2 THEN '0.5' ELSE '-1' END END END AS value,
  type_ok AND numeric_ok AND n % 7 > 0 AND k = 2 AND typed <> 2 AS derived, type_ok AND numeric_ok AND n % 7 > 0 AND k = 2 AND typed = 2 AS reported, type_ok, numeric_ok FROM j""")
def slot_answers(spark, sf_dir):
    l = lines(spark, sf_dir).withColumn("query_id", F.col("l_orderkey")).withColumn("slot_id", F.concat(F.lit("S"), "l_linenumber"))
    n, k, c = F.col("l_quantity").cast("int"), F.col("l_partkey") % 3, F.col("l_suppkey") % 3
    shown = F.when(c > 0, n).otherwise(n + 7000)
    none = F.array().cast("array<string>")
    text = F.concat(F.lit("cells "), shown, F.lit(" and "), n + 1)
    grid = F.concat(F.lit("| a | "), n, F.lit(" |\n| b | "), n + 1, F.lit(" |\n| absolute delta | 0.5 |"))
    extracted = l.select(
        "query_id", "slot_id", F.when(k == 0, "direct").when(k == 1, "count").otherwise("difference").alias("operation"), F.array(F.lit("table")).alias("types"), F.when(n % 7 > 0, "supported").otherwise("conflict").alias("status"),
        F.when(k == 0, "a name").when(k == 1, n.cast("string")).alias("value"), F.when(k == 2, F.array(n.cast("string"), (n + 1).cast("string"))).otherwise(none).alias("operands"), none.alias("conditions"), none.alias("held"),
    )
    support = l.where("l_suppkey % 2 = 0").select("query_id", "slot_id", F.lit("C001").alias("card_key"), F.when(F.col("l_partkey") % 5 == 1, "figure").otherwise("table").alias("source_type"), text.alias("text"), F.when(F.col("l_partkey") % 5 == 2, grid).alias("table"))
    return S.slot_answers(extracted, support)


@_query("""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size FROM part) SELECT p_partkey, CASE k WHEN 0 THEN -1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END WHEN 4 THEN 1 ELSE 0 END AS score FROM p""")
def route_condition(spark, sf_dir):
    k, p = F.col("p_partkey") % 6, table(spark, sf_dir, "part")
    columns = F.when(k == 1, F.array(F.lit("CIFAR-10 top"), F.lit("speed"))).when(k == 3, F.array(F.when(F.col("p_size") % 2 == 0, "Tiny ImageNet IPC=50").otherwise("Tiny ImageNet IPC=150"))).otherwise(F.array(F.lit("A")))
    text = F.when(k == 0, "speed and memory").when(k == 1, "speed").when(k == 2, "all of CIFAR 10, accuracy").when(k == 4, "tiny-imagenet with ipc 50").otherwise("nothing")
    route = F.when(k < 3, "test accuracy on CIFAR-10").when(k == 5, "dataset: x").otherwise("dataset: Tiny ImageNet; ipc = 50")
    return p.select("p_partkey", S.route_condition(F.when(k == 1, columns).when(k == 3, columns).otherwise(F.array(F.lit("A"))), F.when(k == 1, "accuracy").otherwise(text), route, F.lit("")).alias("score"))


_GRID = """concat('| Model | SetA | SetB |\\n|---|---|---|\\n| metric | F1 | EM |\\n| x | y | z |\\n| other | 1 | 2 |\\n| Ours 500→1 | 7', {0}, ' | 8 |\\n| ICAE 500→1 | 6', {0}, ' | 5 |\\n| absolute | +', {0}, '.5 | +3 |')"""


def catalog(spark, sf_dir):
    """Every line of an order as a record: tables, references and texts."""
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, F.expr(_GRID.format("l_suppkey"))).when(k == 1, F.concat(F.col("l_mode"), F.lit(" Smith"), "l_suppkey", F.lit(",  B. Doe. A title of 2020."))).otherwise(F.concat(F.lit("We like "), "l_mode", F.lit(". All tests were run on "), "l_partkey", F.lit(" A100 GPU cards; it took long.")))
    kind = F.when(k == 0, "table").when(k == 1, "citation_context").otherwise("text_span")
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("query_id"), F.format_string("E%04d", "l_linenumber").alias("evidence_ref"), (F.col("l_suppkey") % 4).alias("paper_id"), (F.col("l_suppkey") % 6).alias("cited"), kind.alias("source_type"), text.alias("text"), F.col("l_linenumber").alias("place"))


def wanted(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    question = F.when(F.col("o_custkey") % 3 == 0, "How much better is F1 on SetA?").when(F.col("o_custkey") % 3 == 1, "Who is the first author of the 4th reference?").otherwise("Which GPU hardware?")
    return o.select(F.col("o_orderkey").alias("query_id"), question.alias("question"), F.when(F.col("o_custkey") % 2 == 0, F.array((F.col("o_custkey") % 4))).otherwise(F.array().cast("array<bigint>")).alias("papers"))


def windows(spark, sf_dir, held=None):
    held = held or staged(catalog(spark, sf_dir), "catalog")
    anchors = held.select("query_id", "place", "evidence_ref", F.when(F.col("place") % 2 == 0, "rich_l2_card").otherwise("navigation").alias("reason"))
    near = held.select("query_id", F.col("evidence_ref").alias("anchor_ref"), F.col("place"), F.format_string("E%04d", F.col("place") + 1).alias("evidence_ref"))
    return R.windows(anchors, held, near, wanted(spark, sf_dir))


_SQL_WINDOWS = f"{SQL_LINES}, w AS (SELECT l.*, printf('W%03d', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)) AS window_id, o_custkey % 3 AS k, o_custkey FROM lines l JOIN orders ON o_orderkey = l_orderkey)"


@_query(f"""
WITH {_SQL_WINDOWS} SELECT w.l_orderkey AS query_id, window_id, printf('E%04d', w.l_linenumber) AS anchor_ref, [CASE WHEN w.l_linenumber % 2 = 0 THEN 'rich_l2_card' ELSE 'navigation' END] AS reasons,
  CASE WHEN n.l_orderkey IS NULL THEN [printf('E%04d', w.l_linenumber)] ELSE [printf('E%04d', w.l_linenumber), printf('E%04d', w.l_linenumber + 1)] END AS support_refs, CASE w.l_linenumber % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'citation_context' ELSE 'text_span' END AS source_type, CASE WHEN w.l_linenumber % 3 = 0 THEN 8 END AS lines
FROM w LEFT JOIN lines n ON n.l_orderkey = w.l_orderkey AND n.l_linenumber = w.l_linenumber + 1""")
def evidence_windows(spark, sf_dir):
    return windows(spark, sf_dir).select("query_id", "window_id", "anchor_ref", "reasons", "support_refs", "source_type", F.size("lines").alias("lines")).withColumn("lines", F.when(F.col("lines") >= 0, F.col("lines")))


@_query(f"WITH {_SQL_WINDOWS} SELECT l_orderkey AS query_id, window_id, 'Reference 4' AS subject, 'cites' AS predicate, l_mode || ' Smith' || l_suppkey AS object FROM w WHERE k = 1 AND l_linenumber % 3 = 1 AND l_suppkey % 6 = 4 AND (o_custkey % 2 = 1 OR l_suppkey % 4 = o_custkey % 4)")
def citation_relations(spark, sf_dir):
    return R.citation_relations(windows(spark, sf_dir), catalog(spark, sf_dir), wanted(spark, sf_dir))


@_query(f"WITH {_SQL_WINDOWS} SELECT l_orderkey AS query_id, window_id, 'experiments' AS subject, 'uses' AS predicate, l_partkey || ' A100 GPU cards' AS object, 'All tests were run on ' || l_partkey || ' A100 GPU cards; it took long.' AS quote FROM w WHERE k = 2 AND l_linenumber % 3 = 2")
def hardware_relations(spark, sf_dir):
    return R.hardware_relations(windows(spark, sf_dir), catalog(spark, sf_dir), wanted(spark, sf_dir))


@_query(f"WITH {_SQL_WINDOWS} SELECT l_orderkey AS query_id, window_id, 'SetA' AS dataset, 'F1' AS metric, '7' || l_suppkey AS ours, '6' || l_suppkey AS baseline, '+' || l_suppkey || '.5' AS delta FROM w WHERE k = 0 AND l_linenumber % 3 = 0")
def table_relations(spark, sf_dir):
    return R.table_relations(windows(spark, sf_dir), wanted(spark, sf_dir))


@_query(f"""
WITH {_SQL_WINDOWS} SELECT l_orderkey AS query_id, 1 AS level, 'T' || l_linenumber AS triple_id, window_id, 1 + (SELECT count(*) FROM lines n WHERE n.l_orderkey = w.l_orderkey AND n.l_linenumber = w.l_linenumber + 1)::INT AS refs FROM w WHERE l_linenumber % 2 = 0
UNION ALL SELECT l_orderkey, 0, 'T' || l_linenumber, NULL, 1 FROM w WHERE l_linenumber % 2 = 1""")
def window_expansions(spark, sf_dir):
    held = staged(catalog(spark, sf_dir), "catalog")
    w = staged(windows(spark, sf_dir, held).select("query_id", "window_id", "anchor_ref", "support_refs", "anchor_quote"), "windows")  # what expansions read: texts and lines stay where they are
    n = F.regexp_extract("anchor_ref", r"(\d+)", 1).cast("int")
    triples = w.select("query_id", F.concat(F.lit("T"), n).alias("triple_id"), F.when(n % 3 > 0, F.array("window_id")).otherwise(F.when(n % 2 == 0, F.array("window_id")).otherwise(F.array().cast("array<string>"))).alias("windows"), F.array("anchor_ref").alias("refs"))
    decisions = w.select("query_id", F.when(n % 2 == 0, 1).otherwise(0).alias("level"), F.concat(F.lit("T"), n).alias("triple_id"))
    found = R.expansions(decisions, triples, w, held)
    return found.select("query_id", "level", "triple_id", "window_id", F.size("refs").alias("refs"))


# --- what a task is: the plan of an order's lines first, its question where the plan is silent

_NAME = "CASE l_partkey % 6 WHEN 0 THEN 'Text' WHEN 1 THEN 'figs' WHEN 2 THEN ' table ' WHEN 3 THEN 'novel' WHEN 4 THEN 'equation_algorithm' ELSE '' END"


@_query(f"""
WITH {SQL_LINES}, n AS (SELECT l_orderkey AS q, l_linenumber AS k, {_NAME} AS name, l_mode AS m FROM lines),
a AS (SELECT q, min(k) AS k, CASE lower(trim(name)) WHEN 'text' THEN 'text_span' WHEN 'figs' THEN 'figure' WHEN 'table' THEN 'table' WHEN 'equation_algorithm' THEN 'equation_algorithm' END AS t FROM n GROUP BY q, t HAVING t IS NOT NULL), l AS (SELECT q, list(t ORDER BY k) AS types FROM a GROUP BY q),
p AS (SELECT q, list(t ORDER BY k) AS types FROM (SELECT q, trim(name) AS t, min(k) AS k FROM n WHERE trim(name) IN ('table', 'equation_algorithm') GROUP BY ALL) GROUP BY q),
e AS (SELECT q, list(m ORDER BY k) AS e FROM (SELECT q, m, min(k) AS k FROM n GROUP BY ALL) GROUP BY q),
o AS (SELECT o_orderkey AS q, {_QUESTION} AS question, o_custkey FROM orders),
r AS (SELECT o.q, coalesce(l.types, []) AS named, CASE WHEN o_custkey % 2 = 0 AND p.types IS NOT NULL THEN p.types WHEN o_custkey % 4 = 0 THEN ['table'] ELSE [] END AS types, CASE WHEN o_custkey % 7 BETWEEN 1 AND 6 THEN o_custkey % 7 END AS n, CASE WHEN o_custkey % 5 = 0 THEN coalesce(e, []) ELSE [] END AS ents, o_custkey % 3 = 0 OR o_custkey % 11 = 0 AND o_custkey % 3 = 1 AS crossing, question LIKE 'Compare%' AS asks FROM o LEFT JOIN l USING (q) LEFT JOIN p USING (q) LEFT JOIN e USING (q))
SELECT q AS query_id, array_to_string(named, ',') AS named, array_to_string(types, ',') AS types, coalesce(types[1], '') AS "primary", CASE WHEN coalesce(n >= 2, false) OR crossing AND len(ents) > 0 OR asks THEN 'multi_paper' ELSE 'single_paper' END AS family, n::INT AS paper_count, len(ents)::INT AS entities FROM r""")
def task_structures(spark, sf_dir):
    own = lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.expr(_NAME).alias("name"), "l_mode"))).alias("x"))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "query_id").join(own, "query_id", "left").withColumn("question", F.expr(_QUESTION))
    c, names = F.col("o_custkey"), F.transform("x", lambda e: e["name"])
    cross = F.when(c % 3 == 0, True).when(c % 3 == 1, False)
    s = L.task_structure(F.col("question"), F.when(c % 2 == 0, names), c % 7, F.lit(None).cast("array<string>"), F.when(c % 5 == 0, F.transform("x", lambda e: e["l_mode"])), cross, F.when(c % 11 == 0, c % 3 == 1))
    return rows.select("query_id", F.array_join(L.source_types(names), ",").alias("named"), s.alias("s")).select("query_id", "named", F.array_join("s.types", ",").alias("types"), "s.primary", "s.family", "s.paper_count", F.size("s.entities").alias("entities"))
