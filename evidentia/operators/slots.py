"""Slot plans: what a question needs piece by piece, the routes to it, and the check of what was extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as L, text as T
from .scoring import rank_by
from .tables import match_columns

# Closed classes of slots and how planners name them.
ROLES = ("direct_answer", "condition", "contributor")
OPERATIONS = ("direct", "difference", "maximum", "minimum", "count", "list")
OPERATION_ALIASES = {"literal": "direct", "literal_extraction": "direct", "extract": "direct", "comparison": "difference"}
TYPE_ALIASES = {"text": "text_span", "paragraph": "text_span", "citation": "citation_context", "equation": "equation_algorithm", "algorithm": "equation_algorithm"}
TYPES = ("text_span", "table", "figure", "equation_algorithm", "citation_context")
MOST_SLOTS = 16
NUMBER = r"[-+]?\d+(?:\.\d+)?"
QUALIFIED = r"\b([A-Za-z][A-Za-z0-9-]{2,}\s*\([^()]{3,80}\))"


def _named(value: Column, aliases: dict[str, str]) -> Column:
    out = value
    for k, v in aliases.items():
        out = F.when(F.lower(value) == k, v).otherwise(out)
    return out


def _strings(values: Column, most: int = 12) -> Column:
    """The first different texts that say something."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: T.clip(v, 160)), lambda v: v != "")), 1, most)


def slot_plan(raw: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, slot_id, role, operation, types, entities, conditions, audit: planned slots that can be worked on.

    raw: query_id, at, role, operation, types, entities, conditions; questions: query_id, question, preferred (types),
    operation, focus (entities), multi. Types and operations get their usual names. A slot that asks for text alone takes the numbered
    objects of its question, one without types the question's preferred ones; slots of an unknown role or operation and those
    behind the sixteenth go. A question without slots gets one of its own. For questions about several papers, a list
    slot of several entities becomes one slot per entity.
    """
    q = questions.select("query_id", "preferred", "multi", F.col("operation").alias("_operation"), "focus", L.numbered_types(F.col("question")).alias("numbered"))
    rows = raw.join(q, "query_id")
    asked = F.array_distinct(F.filter(F.transform(_strings(F.col("types"), 5), lambda t: _named(t, TYPE_ALIASES)), lambda t: t.isin(*TYPES)))
    rows = rows.withColumn("_types", asked)
    numbered = (F.size("_types") == 1) & (F.get("_types", F.lit(0)) == "text_span") & (F.size("numbered") > 0)
    rows = rows.withColumn("audit", F.when(numbered, "slot_source_type_explicitly_corrected").otherwise("slot_accepted"))
    rows = rows.withColumn("types", F.when(numbered, F.col("numbered")).when(F.size("_types") == 0, F.col("preferred")).otherwise(F.col("_types")))
    rows = rows.withColumn("role", F.coalesce(F.nullif("role", F.lit("")), F.lit("direct_answer"))).withColumn("operation", _named(F.lower(F.coalesce(F.nullif("operation", F.lit("")), F.lit("direct"))), OPERATION_ALIASES))
    rows = rows.where(F.col("role").isin(*ROLES) & F.col("operation").isin(*OPERATIONS) & (F.size("types") > 0))
    rows = rows.withColumn("at", rank_by(["query_id"], F.asc("at"))).where(F.col("at") <= MOST_SLOTS)
    rows = rows.select("query_id", "at", "role", "operation", "types", _strings(F.col("entities")).alias("entities"), _strings(F.col("conditions")).alias("conditions"), "multi", "audit")
    none = q.join(rows.select("query_id").distinct(), "query_id", "left_anti")
    none = none.select("query_id", F.lit(1).cast("long").alias("at"), F.lit("direct_answer").alias("role"), F.col("_operation").alias("operation"), F.col("preferred").alias("types"), F.col("focus").alias("entities"), F.array().cast("array<string>").alias("conditions"), F.lit(False).alias("multi"), F.lit("slot_plan_fallback").alias("audit"))
    rows = rows.unionByName(none)
    split = F.col("multi") & (F.col("operation") == "list") & (F.size("entities") > 1)
    rows = rows.withColumn("audit", F.when(split, "cross_paper_list_slot_split").otherwise(F.col("audit"))).withColumn("_each", F.when(split, F.transform("entities", lambda e: F.array(e))).otherwise(F.array("entities")))
    rows = rows.select("query_id", "at", "role", "operation", "types", "conditions", "audit", F.posexplode("_each").alias("_k", "entities"))
    rows = rows.withColumn("_n", rank_by(["query_id"], F.asc("at"), F.asc("_k"))).where(F.col("_n") <= MOST_SLOTS)
    return rows.select("query_id", F.format_string("S%03d", "_n").alias("slot_id"), "role", "operation", "types", "entities", "conditions", "audit")


def slot_routes(slots: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, slot_id, types, query, catalog_fallback: the searches of each slot (query_id, slot_id, types, entities, conditions).

    A query holds the types, entities and conditions, or the question where there are none; for citations, text counts
    too. Entities that the question qualifies in brackets have a query of their own. Queries stand once per question,
    in the order of slots, with four characters at least. A table slot of one entity and four conditions may look
    beyond what was scored, and so may qualified ones.
    """
    rows = slots.join(questions.select("query_id", "question"), "query_id")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    main = flat(F.array_join(F.filter(F.concat("types", "entities", "conditions"), lambda x: F.trim(x) != ""), " "))
    main = F.when(main == "", flat(T.text_of(F.col("question")))).otherwise(main)
    lookup = (F.size("types") == 1) & (F.get("types", F.lit(0)) == "table") & (F.size("entities") == 1) & (F.size("conditions") >= 4)
    keys = F.transform("entities", lambda e: F.regexp_replace(F.lower(F.regexp_replace(e, r"\s*\([^()]*\)\s*$", "")), "[^a-z0-9]+", ""))
    qualified = F.filter(F.regexp_extract_all(T.text_of(F.col("question")), F.lit(QUALIFIED), 1), lambda m: F.array_contains(keys, F.regexp_replace(F.lower(F.regexp_extract(m, r"^([A-Za-z][A-Za-z0-9-]+)", 1)), "[^a-z0-9]+", "")))
    extra = F.transform(qualified, lambda m: F.struct(flat(F.concat_ws(" ", F.array_join("types", " "), F.regexp_replace(m, r"[()]", " "))).alias("query"), F.lit(True).alias("catalog_fallback")))
    every = F.concat(F.array(F.struct(main.alias("query"), lookup.alias("catalog_fallback"))), extra)
    wider = F.when(F.array_contains("types", "citation_context"), F.array_append("types", F.lit("text_span"))).otherwise(F.col("types"))
    rows = rows.withColumn("_wider", wider).withColumn("_every", every).select("query_id", "slot_id", F.col("_wider").alias("types"), F.posexplode("_every").alias("_k", "r")).select("query_id", "slot_id", "types", "_k", "r.query", "r.catalog_fallback").where(F.length("query") >= 4)
    rows = rows.withColumn("_i", rank_by(["query_id", "query"], F.asc("slot_id"), F.asc("_k"))).where("_i = 1")
    return rows.select("query_id", "slot_id", "types", "query", "catalog_fallback")


def reported_difference(table: Column, first: Column, second: Column) -> Column:
    """The absolute delta that a pipe table states for two of its cells: the first such row below both in their column, in the leftmost of the nearest. Null without any."""
    lines = F.filter(F.transform(F.split(T.text_of(table), "\n"), lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))), lambda r: F.size(r) >= 2)
    name = lambda r: F.translate(F.lower(F.get(r, F.lit(0))), "∆Δδ", "ddd")
    says = lambda r: name(r).contains("absolute") & name(r).rlike(r"delta|(?<![a-z])d(?![a-z])")

    def last(rows: Column, column: Column, value: Column) -> Column:
        return F.array_max(F.transform(rows, lambda r, i: F.when(F.get(r, column) == value, i)))

    def delta(rows: Column, named: Column, column: Column, after: Column) -> Column:
        cell = lambda i: F.get(F.get(rows, i), column)
        return F.array_min(F.transform(F.filter(named, lambda i: (i > after) & F.coalesce(cell(i).rlike(NUMBER), F.lit(False))), lambda i: F.struct((i - after).alias("far"), column.alias("column"), cell(i).alias("value"))))

    def within(rows: Column, ends: Column) -> Column:
        """The texts are cut, cleaned and named once; columns without both cells are done with at once."""
        width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
        below = lambda c: F.when(last(rows, c, ends["a"]).isNotNull() & last(rows, c, ends["b"]).isNotNull(), F.greatest(last(rows, c, ends["a"]), last(rows, c, ends["b"])))
        open_ = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda c: F.struct(c.alias("c"), below(c).alias("after"))), lambda x: x["after"].isNotNull())
        named = F.filter(F.transform(rows, lambda r, i: F.when(says(r), i)), lambda i: i.isNotNull())
        return T.bound(F.struct(open_.alias("open"), named.alias("named")), lambda v: F.array_min(F.filter(F.transform(v["open"], lambda x: delta(rows, v["named"], x["c"], x["after"])), lambda x: x.isNotNull()))["value"])

    found = T.bound(lines, lambda rows: T.bound(F.struct(F.trim(first).alias("a"), F.trim(second).alias("b")), lambda ends: within(rows, ends)))
    held = F.contains(T.text_of(table), F.trim(first)) & F.contains(T.text_of(table), F.trim(second))  # cheap, and true of every table that has both cells
    return F.when((T.text_of(first) != "") & (T.text_of(second) != "") & held, found)


def aligned_rows(values: DataFrame, cells: DataFrame, schema: DataFrame) -> DataFrame:
    """query_id, row, name, value: table rows that hold one of the values, under the schema's columns.

    values: query_id, value; cells: query_id, row, label, key (header), value; schema: query_id, name, place. The first
    column of the schema takes the row's label, each other one the cell under the header that means it.
    """
    hit = cells.join(values.select("query_id", "value").distinct(), ["query_id", "value"], "left_semi").where(F.trim(T.text_of(F.col("label"))) != "").select("query_id", "row").distinct()
    rows = cells.join(hit, ["query_id", "row"])
    other = schema.where("place > 0").select("query_id", "name")
    named = rows.join(match_columns(rows, other, "query_id"), ["query_id", "key"]).groupBy("query_id", "row", "name").agg(F.min("value").alias("value"))
    first = rows.select("query_id", "row", "label").distinct().join(schema.where("place = 0"), "query_id").select("query_id", "row", "name", F.col("label").alias("value"))
    return first.unionByName(named.select("query_id", "row", "name", "value"))


def slot_answers(extracted: DataFrame, support: DataFrame) -> DataFrame:
    """query_id, slot_id, status, value, derived, reported, type_ok, numeric_ok of extracted slots.

    extracted: query_id, slot_id, operation, types, status, value, operands (array), conditions (array the slot wants),
    held (array of the operands' conditions); support: query_id, slot_id, card_key, source_type, text, table (the text of a table record, else null).
    A slot is supported if the model says so, a known card of its types backs it, its numbers stand in the cards' texts
    where it counts or compares, a difference's operands share a table and its conditions, and there is a value. A
    difference is the delta that a table states, else the exact difference of two operands.
    """
    cards = support.groupBy("query_id", "slot_id").agg(F.collect_set("source_type").alias("_kinds"), F.array_join(F.array_sort(F.collect_set(T.text_of(F.col("text")))), "\n").alias("_text"), F.array_sort(F.collect_set("table")).alias("_tables"))
    rows = extracted.join(cards, ["query_id", "slot_id"], "left")
    numbers = lambda c: F.regexp_extract_all(T.text_of(c), F.lit(NUMBER), 0)
    there = lambda c: F.size(F.array_except(numbers(c), numbers(F.col("_text")))) == 0
    first, second = (F.get("operands", F.lit(k)) for k in (0, 1))
    pair = F.size("operands") == 2
    differs = F.col("operation") == "difference"
    rows = rows.withColumn("type_ok", F.col("_kinds").isNotNull() & ((F.size("types") == 0) | F.coalesce(F.arrays_overlap("types", "_kinds"), F.lit(False))))
    stated = F.get(F.filter(F.transform("_tables", lambda t: reported_difference(t, first, second)), lambda v: v.isNotNull()), F.lit(0))
    rows = rows.withColumn("_stated", F.when(differs & pair, stated))
    counts = F.col("operation").isin("difference", "maximum", "minimum", "count") | T.text_of(F.col("value")).rlike(rf"^\s*{NUMBER}\s*%?\s*$")
    right = F.when(differs, F.forall("operands", there)).when(counts, there(F.col("value"))).otherwise(True)
    rows = rows.withColumn("numeric_ok", right & ((F.col("operation") != "count") | T.text_of(F.col("value")).rlike(r"^\s*[0-9]+\s*$")))
    terms = F.size(F.array_except(F.transform("conditions", lambda c: F.lower(c)), F.transform("held", lambda c: F.lower(c)))) == 0
    shared = F.exists("_tables", lambda t: F.forall("operands", lambda v: F.contains(t, v)))
    conditions = ~differs | (F.size("conditions") == 0) | (terms & F.coalesce(shared, F.lit(False)))
    exact = T.decimal_text(first.try_cast("decimal(30,10)") - second.try_cast("decimal(30,10)"))
    value = F.when(differs, F.coalesce("_stated", F.when(pair, exact))).otherwise(F.col("value"))
    good = (F.col("status") == "supported") & F.col("type_ok") & F.coalesce(F.col("numeric_ok"), F.lit(False)) & conditions & (T.text_of(value) != "")
    good = F.coalesce(good, F.lit(False))
    return rows.select("query_id", "slot_id", F.when(good, "supported").otherwise("partial").alias("status"), F.when(good, value).alias("value"), (good & differs & F.col("_stated").isNull()).alias("derived"), (good & differs & F.col("_stated").isNotNull()).alias("reported"), "type_ok", F.coalesce("numeric_ok", F.lit(False)).alias("numeric_ok"))


def route_condition(columns: Column, text: Column, route: Column, question: Column) -> Column:
    """From -1 to 3, how well a table (columns, text) meets the route's benchmark and metric, or its dataset and IPC."""
    bare = lambda c: F.regexp_replace(F.lower(T.text_of(c)), "[^a-z0-9]+", "")
    low = F.lower(T.text_of(text))
    accuracy = F.concat_ws(" ", T.text_of(route), T.text_of(question)).rlike(r"(?i)\b(?:test\s+)?accuracy\b")
    other = ~low.rlike(r"\baccuracy\b") & low.rlike(r"\b(?:speed|memory|latency|runtime)\b")
    names = F.filter(F.array_distinct(F.transform(F.regexp_extract_all(T.text_of(route), F.lit(r"\b[A-Za-z]+(?:-[A-Za-z]+)*-?\d+\b"), 0), bare)), lambda n: n != "")
    plain = F.transform(columns, bare)
    matched = F.aggregate(F.flatten(F.transform(names, lambda n: F.transform(plain, lambda c: c.contains(n).cast("int")))), F.lit(0), lambda s, x: s + x)
    by_metric = F.when(other, -1).when(matched > 0, F.least(F.lit(3), 1 + matched)).when(F.exists(names, lambda n: F.contains(bare(text), n)), 1)
    dataset = bare(F.regexp_extract(T.text_of(route), r"(?i)\bdataset\s*:\s*([A-Za-z][\w-]*(?:\s+[A-Za-z][\w-]*){0,3})", 1))
    ipc = F.regexp_extract(T.text_of(route), r"(?i)\bipc\s*[=:]\s*(\d+)\b", 1)
    number = lambda c: F.array_contains(F.regexp_extract_all(c, F.lit(r"\d+"), 0), ipc)
    both = F.exists(columns, lambda c: F.contains(bare(c), dataset) & number(c))
    by_setting = F.when((dataset == "") | (ipc == ""), 0).when(both, 2).when(F.contains(bare(text), dataset) & low.rlike(r"\bipc\b") & number(low), 1).otherwise(0)
    return F.coalesce(F.when(accuracy, by_metric), by_setting)
