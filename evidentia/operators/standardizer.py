"""Parsed elements of documents to typed records, with the records that only their context gives away: windows and joins, no loop.

Derived records stand behind a document's own: a generic Equation 0 for pages with formulas, else for mathematical prose;
pointers to equations that prose names and no formula shows; figures and tables of which only a caption is left.
Paragraphs of a reference list become its entries, continued lines joined to the entry they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import section_heading, text_of
from ..session import dealt_by_size, staged

#: Elements that meet in one task.
PART = 100_000

# Structural types, label patterns, marks of formulas and of reference entries, texts of derived records.
STRUCTURES = {"table": ("table", "document_table"), "figure": ("picture", "image", "figure"), "equation": ("formula", "equation")}
LABELS = {
    "table": ("Table ", r"(?i)\b(?:Table|Tab\.)\s*([A-Za-z]?\d+[A-Za-z0-9.\-]*)"),
    "figure": ("Figure ", r"(?i)\b(?:Figure|Fig\.)\s*([A-Za-z]?\d+[A-Za-z0-9.\-]*(?:\([a-z]\))?)"),
    "algorithm": ("Algorithm ", r"(?i)\bAlgorithm\s*([A-Za-z]?\d+[A-Za-z0-9.\-]*)"),
    "equation": ("Equation ", r"(?i)\b(?:Equation|Eq\.)\s*\(?\s*([A-Za-z]?\d+[A-Za-z0-9.\-]*)\s*\)?"),
}
MATH = (
    r"(?i)(?:[=≈≤≥]|∑|∏|∇|∂|∫).*(?:[α-ωΑ-Ωπθβγλσ]|\b(?:log|exp|min|max|alpha|beta|theta|gamma|lambda)\b)"
    r"|(?:[α-ωΑ-Ωπθβγλσ]|\b(?:log|exp|min|max|alpha|beta|theta|gamma|lambda)\b).*(?:[=≈≤≥]|∑|∏|∇|∂|∫)"
)
REFERENCE_LIST = r"(?i)\b(?:References|Bibliography)\b"
ENTRY_NUMBER = (r"^\s*\[\s*(\d{1,4})\s*\]", r"^\s*(\d{1,4})\s*[.)]")
CONTINUED = r"^\s*(?:[a-z]|[,;:)\]])"
LEAST_ENTRY = 20
ALIAS_TEXT = "Generic page-level equation locator for an unnumbered official reference. Displayed formula source: "
MATH_TEXT = "Unnumbered mathematical expression recovered from a text block. "
POINTER_TEXT = " is referenced in this passage; the displayed equation body was not emitted by the parser. "

_FIELDS = ("paper_id", "at", "page", "record_type", "source_type", "label", "text", "rules", "warnings", "source_at")


def _label(text: Column, kind: str) -> Column:
    """The first label of this kind that a text names, or null."""
    word, pattern = LABELS[kind]
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.concat(F.lit(word), F.regexp_replace(found, r"[.,;:]+$", ""))


def _rules(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def typed(elements: DataFrame) -> DataFrame:
    """_FIELDS and caption (whether it is one) of the elements (paper_id, at, page, element_type, backend_type, label, text) that have a text.

    Formulas and tables are told by their structure, not by words: prose that names an equation stays prose. A formula without a printed
    number is Equation 0.
    """
    raw = F.lower(F.coalesce(F.nullif("backend_type", F.lit("")), F.col("element_type"), F.lit("")))
    rows = elements.select("paper_id", F.col("at").cast("long").alias("at"), F.col("page").cast("long").alias("page"), raw.alias("_raw"), F.nullif("label", F.lit("")).alias("_own"), F.regexp_replace(text_of(F.col("text")), r"^\s+|\s+$", "").alias("text"), (F.lower(text_of(F.col("backend_type"))) == "caption").alias("caption")).where("text <> ''")
    code = (F.col("_raw") == "code") & _label(F.col("text"), "algorithm").isNotNull()
    known = F.when(F.col("_raw").isin(*STRUCTURES["table"]), "table").when(F.col("_raw").isin(*STRUCTURES["figure"]), "figure").when(F.col("_raw").isin(*STRUCTURES["equation"]), "equation").when(code, "algorithm").when(section_heading(F.col("text")), "section_header").otherwise("paragraph")
    rows = rows.withColumn("record_type", known)
    of = F.col("record_type")
    source = F.when(of.isin("equation", "algorithm"), "equation_algorithm").when(of.isin("section_header", "paragraph"), "text_span").otherwise(of)
    either = F.coalesce(_label(F.col("text"), "algorithm"), _label(F.col("text"), "equation"))
    printed = F.coalesce("_own", F.when(of == "table", _label(F.col("text"), "table")).when(of == "figure", _label(F.col("text"), "figure")).when(source == "equation_algorithm", either))
    bare = (of == "equation") & printed.isNull()
    label = F.when(of == "section_header", F.col("text")).when(bare, "Equation 0").otherwise(printed)
    rule = F.when(of == "table", "table_element").when(of == "figure", "picture_element").when(of == "equation", "formula_element").when(of == "algorithm", "code_with_algorithm_label").when(of == "section_header", "heading").otherwise("plain_text")
    rules = F.concat(F.array(rule), F.when(bare, _rules("unnumbered_formula_is_equation_0")).otherwise(_rules()))
    return rows.select("paper_id", "at", "page", "record_type", source.alias("source_type"), label.alias("label"), "text", rules.alias("rules"), _rules().alias("warnings"), F.lit(None).cast("long").alias("source_at"), "caption")


def derived(rows: DataFrame) -> DataFrame:
    """_FIELDS of the records that typed() rows give away, with at counted on behind each paper's own records."""
    paged = rows.where("page IS NOT NULL")
    formulas = paged.where("source_type = 'equation_algorithm'")
    prose = paged.where("source_type = 'text_span'")
    first = lambda df: df.groupBy("paper_id", "page").agg(F.min(F.struct("at", "text")).alias("_x")).select("paper_id", "page", "_x.*")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    zero = formulas.where("label = 'Equation 0'").select("paper_id", "page").distinct()
    shown = first(formulas.where("record_type = 'equation'")).join(zero, ["paper_id", "page"], "left_anti")
    math = first(prose.where(F.length(flat).between(16, 2200) & flat.rlike(MATH))).join(zero.unionByName(shown.select("paper_id", "page")), ["paper_id", "page"], "left_anti")

    def made(df: DataFrame, step: int, record_type: str, source_type: str, label: Column, text: Column, rule: str, *warnings: str) -> DataFrame:
        place = F.col("_pos") if "_pos" in df.columns else F.lit(0)
        return df.select("paper_id", F.lit(step).alias("_step"), F.col("at").alias("source_at"), place.alias("_pos"), "page", F.lit(record_type).alias("record_type"), F.lit(source_type).alias("source_type"), label.alias("label"), text.alias("text"), _rules(rule).alias("rules"), _rules(*warnings).alias("warnings"))

    zeros = made(shown, 1, "equation", "equation_algorithm", F.lit("Equation 0"), F.concat(F.lit(ALIAS_TEXT), "text"), "page_alias_of_formula", "generic_locator", "printed_number_kept_apart")
    zeros = zeros.unionByName(made(math, 2, "equation", "equation_algorithm", F.lit("Equation 0"), F.concat(F.lit(MATH_TEXT), "text"), "mathematical_text_is_equation_0", "formula_not_separated_from_text"))
    named = prose.select("paper_id", "page", "at", "text", F.posexplode(F.regexp_extract_all("text", F.lit(LABELS["equation"][1]), 1)).alias("_pos", "_n")).withColumn("label", F.concat(F.lit("Equation "), F.regexp_replace("_n", r"[.,;:]+$", "")))
    known = formulas.select("paper_id", "page", "label").unionByName(zeros.select("paper_id", "page", "label")).where("label IS NOT NULL").distinct()
    once = W.partitionBy("paper_id", "page", "label").orderBy("at", "_pos")
    named = named.join(known, ["paper_id", "page", "label"], "left_anti").withColumn("_rn", F.row_number().over(once)).where("_rn = 1")
    out = zeros.unionByName(made(named, 3, "equation_reference", "equation_algorithm", F.col("label"), F.concat("label", F.lit(POINTER_TEXT), "text"), "pointer_to_named_equation", "formula_unavailable"))
    for step, kind, record_type in ((4, "figure", "figure"), (5, "table", "table_caption")):
        captions = rows.where("caption").select("paper_id", "page", "at", "text", _label(F.col("text"), kind).alias("label")).where("label IS NOT NULL")
        seen = rows.where(F.col("source_type") == kind).select("paper_id", "label").where("label IS NOT NULL").distinct()
        alone = captions.join(seen, ["paper_id", "label"], "left_anti").withColumn("_rn", F.row_number().over(W.partitionBy("paper_id", "label").orderBy("at"))).where("_rn = 1")
        out = out.unionByName(made(alone, step, record_type, kind, F.col("label"), F.col("text"), "caption_without_its_object"))
    counts = rows.groupBy("paper_id").agg(F.count("*").alias("_n"))
    place = F.row_number().over(W.partitionBy("paper_id").orderBy("_step", "source_at", "_pos"))
    return out.withColumn("_place", place).join(counts, "paper_id").select("paper_id", (F.col("_n") + F.col("_place")).alias("at"), *_FIELDS[2:])


def reference_entries(rows: DataFrame) -> DataFrame:
    """typed() rows whose reference-list paragraphs are entries labelled `Reference n`; a continued line is part of its entry's text.

    A list runs from a heading that says so to the next other heading. A printed number counts; an entry without one follows the entry before
    it, over all lists of a paper. The first paragraph of a list is an entry however it begins; paragraphs under 20 characters are left as they are.
    """
    head = F.col("record_type") == "section_header"
    order = W.partitionBy("paper_id").orderBy("at")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_run", F.sum(head.cast("int")).over(so_far)).withColumn("_list", F.coalesce(F.last(F.when(head, F.col("text").rlike(REFERENCE_LIST)), ignorenulls=True).over(so_far), F.lit(False)))
    rows = rows.withColumn("_in", F.col("_list") & (F.col("record_type") == "paragraph") & (F.length("text") >= LEAST_ENTRY))
    number = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in ENTRY_NUMBER]).cast("long")
    rows = rows.withColumn("_number", F.when(F.col("_in"), number))
    nth = F.sum(F.col("_in").cast("int")).over(W.partitionBy("paper_id", "_run").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_more", F.col("_in") & F.col("_number").isNull() & (nth > 1) & F.col("text").rlike(CONTINUED)).withColumn("_entry", F.col("_in") & ~F.col("_more"))
    rows = rows.withColumn("_group", F.sum((F.col("_number").isNotNull()).cast("int")).over(so_far)).withColumn("_base", F.coalesce(F.last("_number", ignorenulls=True).over(so_far), F.lit(0)))
    counted = F.sum((F.col("_entry") & F.col("_number").isNull()).cast("int")).over(W.partitionBy("paper_id", "_group").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("_index", F.col("_base") + counted).withColumn("_owner", F.last(F.when(F.col("_entry"), F.col("at")), ignorenulls=True).over(so_far))
    more = rows.where("_more").groupBy("paper_id", F.col("_owner").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_tail"))
    rows = rows.where("NOT _more").join(more, ["paper_id", "at"], "left")
    tail = F.transform("_tail", lambda x: x["text"])
    entry = F.col("_entry")
    return rows.select(
        "paper_id", "at", "page",
        F.when(entry, "reference_entry").otherwise(F.col("record_type")).alias("record_type"),
        F.when(entry, "citation_context").otherwise(F.col("source_type")).alias("source_type"),
        F.when(entry, F.concat(F.lit("Reference "), "_index")).otherwise(F.col("label")).alias("label"),
        F.concat_ws(" ", "text", tail).alias("text"),
        F.concat("rules", F.when(entry, _rules("reference_list_paragraph_is_entry")).otherwise(_rules()), F.transform(F.coalesce("_tail", F.array().cast("array<struct<at:bigint,text:string>>")), lambda x: F.lit("continuation_merged"))).alias("rules"),
        "warnings", "source_at",
    )


def locator(page: Column, source_type: Column, label: Column) -> Column:
    """page (-1: unknown) and the field of a record's label: table_id, figure_id, equation_id, algorithm_id or citation_id."""
    own = lambda c: F.when(c & (F.coalesce(label, F.lit("")) != ""), label)
    algorithm = F.lower(F.coalesce(label, F.lit(""))).startswith("algorithm")
    formula = source_type == "equation_algorithm"
    return F.struct(F.coalesce(page, F.lit(-1)).alias("page"), own(source_type == "table").alias("table_id"), own(source_type == "figure").alias("figure_id"), own(formula & ~algorithm).alias("equation_id"), own(formula & algorithm).alias("algorithm_id"), F.regexp_replace(own(source_type == "citation_context"), "^Reference ", "").alias("citation_id"))


def standardized(elements: DataFrame) -> DataFrame:
    """paper_id, page, record_id, global_record_id, record_type, source_type, label, locator, text, reading_order, rules, warnings, source_at of all records.

    elements: paper_id, at (their number, from 1), page, element_type, backend_type, label, text. Elements without a text give no record but keep
    their number; a null page is -1 (0 in ids). Elements are read once and written typed; a paper's records follow from its elements alone.
    """
    rows = staged(typed(elements), "elements", PART)
    records = reference_entries(dealt_by_size(rows, rows.count(), PART, "paper_id")).select(*_FIELDS).unionByName(derived(rows).select(*_FIELDS))
    page = F.coalesce("page", F.lit(-1))
    name = F.format_string("p%03d_r%04d", F.greatest(F.lit(0), page), "at")
    return records.select("paper_id", page.alias("page"), name.alias("record_id"), F.concat_ws("::", "paper_id", name).alias("global_record_id"), "record_type", "source_type", "label", locator(F.col("page"), F.col("source_type"), F.col("label")).alias("locator"), "text", F.col("at").alias("reading_order"), "rules", "warnings", "source_at")


def page_status(elements: DataFrame, records: DataFrame) -> DataFrame:
    """paper_id, page, n_records, n_missing, status of every page: how many records it has, and for unknown pages how many elements have none."""
    own = records.groupBy("paper_id", "page").agg(F.count("*").alias("n_records"))
    missing = elements.where("page IS NULL").groupBy("paper_id", F.lit(-1).cast("long").alias("page")).agg(F.count("*").alias("n_missing"))
    return own.join(missing, ["paper_id", "page"], "full").select("paper_id", "page", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.when(F.col("n_records") > 0, "complete").otherwise("failed").alias("status"))
