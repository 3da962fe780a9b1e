"""Answer contracts, record joins and stop conditions between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import text_of

#: What a record keeps at run time.
RUNTIME_FIELDS = (
    "paper_id", "page", "record_id", "global_record_id", "section_id", "section_title", "section_level", "section_path",
    "section_type", "record_type", "source_type", "label", "locator", "text", "reading_order", "document_order",
)
#: Crops that the debug table adds to a record.
CROPS = ("crop_path", "table_crop_path", "figure_crop_path", "equation_algorithm_crop_path")
_OBJECT, _LIST = "map<string,string>", "array<string>"


def _first(m: Column, *keys: str) -> Column:
    """The first value of a map under one of the keys that is not empty."""
    return F.coalesce(*[F.nullif(F.get(F.array(F.element_at(m, k)), F.lit(0)), F.lit("")) for k in keys])


def _is(value: Column, bracket: str) -> Column:
    return F.coalesce(F.ltrim(value).startswith(bracket), F.lit(False))


def options(value: Column) -> Column:
    """array<struct<key, text>> of multiple-choice options in a JSON text: an object of key: text, or a list.

    List items are objects (key, label, option or id; text, value, content or answer; or one pair alone) or plain
    texts, which get the letter of their place. Options without a key go; anything else has none.
    """
    pair = lambda key, text: F.struct(F.trim(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    entries = F.transform(F.map_entries(F.from_json(value, _OBJECT)), lambda e: pair(e["key"], e["value"]))

    def item(x: Column, i: Column) -> Column:
        letter, m = F.chr(65 + i), F.from_json(x, _OBJECT)
        key, alone = _first(m, "key", "label", "option", "id"), F.size(m) == 1
        only = key.isNull() & alone
        named = pair(F.when(only, F.get(F.map_keys(m), F.lit(0))).otherwise(F.coalesce(key, letter)), F.when(only, F.get(F.map_values(m), F.lit(0))).otherwise(_first(m, "text", "value", "content", "answer")))
        return F.when(_is(x, "{"), named).otherwise(pair(letter, x))

    found = F.when(_is(value, "{"), entries).when(_is(value, "["), F.transform(F.from_json(value, _LIST), item))
    return F.coalesce(F.filter(found, lambda o: o["key"] != ""), F.array().cast("array<struct<key:string,text:string>>"))


def table_columns(value: Column) -> Column:
    """Column names of a table schema in a JSON text: a list of names or of objects (name, column or key), or an object that holds it as columns or schema. Null without any."""
    held = F.from_json(value, _OBJECT)
    inner = F.coalesce(*[F.when(_is(F.element_at(held, k), "["), F.element_at(held, k)) for k in ("columns", "schema")])
    names = F.transform(F.from_json(F.when(_is(value, "{"), inner).otherwise(value), _LIST), lambda x: F.trim(F.coalesce(F.when(_is(x, "{"), _first(F.from_json(x, _OBJECT), "name", "column", "key")).otherwise(x), F.lit(""))))
    kept = F.filter(F.when(_is(value, "[") | (_is(value, "{") & inner.isNotNull()), names), lambda n: n != "")
    return F.when(F.size(kept) > 0, kept)


def answer_contracts(inputs: DataFrame, validations: DataFrame) -> DataFrame:
    """query_id, answer_types, options, table_schema, options_available, expected_row_count.

    inputs: query_id, answer_types, options, table_schema (JSON texts); validations: the same without answer_types.
    What an input lacks comes from its validation row: shapes only, never answers, rows or papers.
    """
    shapes = validations.select("query_id", F.col("options").alias("_o"), F.col("table_schema").alias("_t"))
    rows = inputs.join(shapes, "query_id", "left")
    found = options(F.coalesce("options", "_o"))
    return rows.select("query_id", "answer_types", found.alias("options"), table_columns(F.coalesce("table_schema", "_t")).alias("table_schema"), (F.size(found) > 0).alias("options_available"), F.lit(0).alias("expected_row_count"))


def runtime_records(records: DataFrame, debug: DataFrame, candidates: DataFrame) -> DataFrame:
    """records with the crops of the debug table (global_record_id; empty ones change nothing) and their paper's candidate score."""
    held = [c for c in CROPS if c in debug.columns]
    side = debug.where("global_record_id <> ''").groupBy("global_record_id").agg(*[F.max(c).alias(f"_{c}") for c in held])
    rows = records.join(side, "global_record_id", "left").join(candidates.select("paper_id", F.col("score").alias("candidate_score")), "paper_id", "left")
    own = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    return rows.select(*[c for c in records.columns if c not in held], *[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), own(c)).alias(c) for c in held], "candidate_score")


def projected_records(records: DataFrame) -> DataFrame:
    """The sixteen run-time fields of records; fields they lack are null."""
    return records.select(*[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in RUNTIME_FIELDS])


def candidate_entries(rows: DataFrame) -> DataFrame:
    """One row per candidate of rows (query_id, candidates array<struct>, and the struct's fields of flat rows).

    A nested candidate without a query_id has its row's; a row whose candidates are null is a candidate itself.
    """
    fields = [f.name for f in rows.schema["candidates"].dataType.elementType.fields]
    others = [c for c in fields if c != "query_id"]
    nested = rows.where("candidates is not null").select(F.col("query_id").alias("_q"), F.explode("candidates").alias("c")).where("c is not null")
    own = F.coalesce("c.query_id", F.col("_q")) if "query_id" in fields else F.col("_q")
    return nested.select(own.alias("query_id"), *[F.col(f"c.{c}").alias(c) for c in others]).unionByName(rows.where("candidates is null").select("query_id", *others))


def extraction_status(papers: DataFrame, records: DataFrame, status: DataFrame) -> DataFrame:
    """paper_id, status, records, available of papers: available papers have a record table and did not fail.

    records: paper_id, n (rows of its table, 0 for an empty one); status: paper_id, status.
    """
    rows = papers.select("paper_id").distinct().join(records.select("paper_id", "n"), "paper_id", "left").join(status.select("paper_id", "status"), "paper_id", "left")
    available = F.col("n").isNotNull() & (F.coalesce("status", F.lit("")) != "failed")
    return rows.select("paper_id", "status", F.coalesce("n", F.lit(0)).cast("long").alias("records"), available.alias("available"))


def sufficient(records: DataFrame, questions: DataFrame, *, least: int = 1, require_primary: bool = True) -> DataFrame:
    """query_id, enough: whether a question's selected records (query_id, source_type, text) are enough to stop.

    That is `least` records of which one says something, and for questions about a figure, table, equation or citation
    (query_id, primary_type) one of that type.
    """
    per = records.join(questions, "query_id", "right").groupBy("query_id", "primary_type").agg(
        F.count("text").alias("n"), F.coalesce(F.bool_or(F.trim(text_of(F.col("text"))) != ""), F.lit(False)).alias("says"), F.coalesce(F.bool_or(F.col("source_type") == F.col("primary_type")), F.lit(False)).alias("own")
    )
    asked = F.lit(require_primary) & F.coalesce(F.col("primary_type").isin("figure", "table", "equation_algorithm", "citation_context"), F.lit(False))
    return per.select("query_id", ((F.col("n") >= max(1, least)) & F.col("says") & (~asked | F.col("own"))).alias("enough"))


def progress_bar(done: Column, total: Column, width: int = 24) -> Column:
    """`[###---] done/total percent`."""
    at = F.greatest(F.lit(0), F.least(done, total))
    filled = F.rint(F.lit(float(width)) * at / total).cast("int")
    percent = F.format_string("%5.1f%%", F.bround(100.0 * at.cast("double") / total, 1))
    shown = F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), width - filled), F.lit("] "), at.cast("string"), F.lit("/"), total.cast("string"), F.lit(" "), percent)
    return F.when(total <= 0, f"[{'-' * width}] 0/0").otherwise(shown)
