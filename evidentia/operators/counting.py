"""Answers that are counts of what evidence shows: parentheses of an equation, a complete reference list, an author's references, works cited in a section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import text_of

# Beginnings of texts that are no bibliography entries, a year, an entry's author, and how questions ask.
NOISE = ("question:", "justification:", "the answer na", "guidelines:", "do the main claims", "1. claims", "2. limitations", "3. ethics", "4. reproducibility")
NOISE_PHRASE = "computation and communication complexity"
YEAR = r"\b(?:19|20)\d{2}\b"
AUTHOR_LED = r"^[A-Z][A-Za-z'´`\-]+,?\s+[A-Z]"
ASKED_EQUATION = r"\bequation\s+(\d{1,3})\b"
ASKED_LAST = ("last reference", "reference index", "index of the last reference")
ASKED_AUTHOR = r"\binclude\s+([A-Z][A-Za-z\-]+)\s+as an author\b"
ASKED_SECTION = r"cited in\s+(?:the\s+)?([a-zA-Z ]+?)\s+section"
CITED = r"(.+?),\s*((?:19|20)\d{2})$"


def is_bibliography(text: Column) -> Column:
    """Whether a text is a bibliography entry: one with a year, or led by an author; no checklist, no caption."""
    own = F.regexp_replace(text_of(text), r"^\s+", "")
    low = F.lower(own)
    noise = reduce(lambda a, b: a | b, [low.startswith(p) for p in NOISE]) | low.rlike(r"^(table|figure)\s*\d") | low.contains(NOISE_PHRASE)
    return ~noise & (low.rlike(YEAR) | own.rlike(AUTHOR_LED))


def citation_number(value: Column) -> Column:
    """A citation id as a number, `#` aside; null if it is none."""
    return F.regexp_replace(F.trim(F.regexp_replace(text_of(value), "#", "")), r"^\+", "").try_cast("long")


def counts(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, rule, value, refs: the questions (query_id, question, papers) that counting their catalog answers.

    catalog: query_id, at, ref, paper_id, source_type, label, text, citation_id, section_title, section_id. papers: only these (null or empty: all).
    A question is answered by the first of four rules that finds something; without one it has no row.

    parentheses: `(` in the first shown body of the equation that the question numbers, the number behind it not counted.
    last_reference: the largest number of a bibliography whose numbers are exactly 1 to n, each once; gaps, repeats or numbers beyond refuse it.
    author: bibliography entries that name the author asked for.
    cited_works: different author-year pairs in parentheses of the section asked for.
    """
    q = text_of(F.col("question"))
    low = F.lower(q)
    pick = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    asked = questions.select(
        "query_id", F.coalesce("papers", F.array().cast("array<string>")).alias("papers"),
        F.when(low.contains("parenthes"), pick(low, ASKED_EQUATION)).alias("equation"),
        reduce(lambda a, b: a | b, [low.contains(p) for p in ASKED_LAST]).alias("last"),
        F.lower(pick(q, ASKED_AUTHOR)).alias("author"),
        F.trim(pick(low, ASKED_SECTION)).alias("section"),
    ).where("equation IS NOT NULL OR last OR author IS NOT NULL OR section IS NOT NULL")
    rows = catalog.join(asked, "query_id").where((F.size("papers") == 0) | F.array_contains("papers", F.coalesce(F.col("paper_id").cast("string"), F.lit(""))))
    text = text_of(F.col("text"))
    shown = rows.where((F.col("source_type") == "equation_algorithm") & F.contains(F.lower(text_of(F.col("label"))), F.concat(F.lit("equation "), "equation")) & ~text.contains("was not emitted") & text.rlike("[=λ∑]"))
    first = shown.withColumn("_rn", F.row_number().over(W.partitionBy("query_id").orderBy("at", "ref"))).where("_rn = 1")
    numbered = text.rlike(r"\(\s*\d{1,3}\s*\)\s*$")
    opened = F.length(text) - F.length(F.translate(text, "(", ""))
    out = first.select("query_id", F.lit(1).alias("turn"), F.lit("parentheses").alias("rule"), (opened - numbered.cast("int")).cast("long").alias("value"), F.array("ref").alias("refs"))
    entries = rows.where((F.col("source_type") == "citation_context") & is_bibliography(F.col("text")))
    ids = entries.where("last").withColumn("_n", citation_number(F.col("citation_id"))).where("_n IS NOT NULL")
    spans = ids.groupBy("query_id", "_n").agg(F.count("*").alias("c"), F.min(F.struct("at", "ref"))["ref"].alias("ref"))
    whole = spans.groupBy("query_id").agg(F.min("_n").alias("a"), F.max("_n").alias("z"), F.count("*").alias("d"), F.sum("c").alias("c"), F.max(F.struct("_n", "ref"))["ref"].alias("ref")).where("a = 1 AND z = d AND z = c")
    out = out.unionByName(whole.select("query_id", F.lit(2).alias("turn"), F.lit("last_reference").alias("rule"), F.col("z").alias("value"), F.array("ref").alias("refs")))
    refs = F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("refs")
    named = entries.where(F.contains(F.lower(text), F.col("author"))).groupBy("query_id").agg(F.count("*").alias("value"), refs)
    out = out.unionByName(named.select("query_id", F.lit(3).alias("turn"), F.lit("author").alias("rule"), "value", "refs"))
    inside = rows.where(F.contains(F.lower(F.concat_ws(" ", "section_title", "section_id")), F.col("section")))
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]*?)\)"), 1), lambda c: F.transform(F.split(c, ";"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))))
    works = inside.select("query_id", F.explode(F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, CITED, 1)).alias("who"), F.regexp_extract(p, CITED, 2).alias("year")))).alias("w")).select("query_id", "w.*").where("who <> ''").distinct().groupBy("query_id").agg(F.count("*").alias("value"))
    cited = works.join(inside.where("ref IS NOT NULL").groupBy("query_id").agg(refs), "query_id", "left")
    out = out.unionByName(cited.select("query_id", F.lit(4).alias("turn"), F.lit("cited_works").alias("rule"), "value", F.coalesce("refs", F.array().cast("array<string>")).alias("refs")))
    return out.withColumn("_rn", F.row_number().over(W.partitionBy("query_id").orderBy("turn"))).where("_rn = 1").select("query_id", "rule", "value", "refs")
