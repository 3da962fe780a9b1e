"""Parsed elements to typed records: types, repairs, rejects, alternate types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import text_of

# Texts that are no content, and marks of other types inside prose.
PLACEHOLDERS = ("...", "n/a", "none", "null", "text", "string", "<text>", "visible page content", "record text")
INSTRUCTIONS = ("output json", "do not output", "use a minimal schema", "for each record")
HEADING = r"(?i)^(?:\d+(?:\.\d+)*\.?\s+)?(?:abstract|introduction|related work|background|preliminaries|method|methods|methodology|approach|experiments?|experimental setup|results?|discussion|conclusions?|limitations|references|bibliography|acknowledge?ments?|appendix)\s*$"
MATH = r"(?:[=≤≥≈∑∏∫].*\b[a-zA-Z]\b)|(?:\b[a-zA-Z]\b.*[=≤≥≈∑∏∫])"


def is_heading(text: Column) -> Column:
    t = F.trim(text_of(text))
    return (F.length(t) <= 64) & t.rlike(HEADING)


def record_type(raw_type: Column, text: Column) -> Column:
    """record_type and source_type of an element: by its structure, an algorithm's code, a heading, else a paragraph."""
    raw = F.lower(text_of(raw_type))
    own = lambda r, s: F.struct(F.lit(r).alias("record_type"), F.lit(s).alias("source_type"))
    return (
        F.when(raw.isin("table", "document_table"), own("table", "table"))
        .when(raw.isin("picture", "image", "figure"), own("figure", "figure"))
        .when(raw.isin("formula", "equation"), own("equation", "equation_algorithm"))
        .when((raw == "code") & F.trim(text_of(text)).rlike(r"(?i)^algorithm\s*[A-Za-z0-9]"), own("algorithm", "equation_algorithm"))
        .when(is_heading(text), own("section_header", "text_span"))
        .otherwise(own("paragraph", "text_span"))
    )


def is_placeholder(text: Column) -> Column:
    low = F.trim(F.regexp_replace(F.lower(text_of(text)), r"\s+", " "))
    out = low.isin(*PLACEHOLDERS)
    for m in INSTRUCTIONS:
        out = out | low.contains(m)
    return out


def is_math_text(text: Column) -> Column:
    """A line of 16 to 2200 characters with an operator and a one-letter name."""
    flat = F.trim(F.regexp_replace(text_of(text), r"\s+", " "))
    return F.length(flat).between(16, 2200) & flat.rlike(MATH)


def repair_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """x0, y0, x1, y1 in order, within 0 to 1000 and whole; null without area. `repaired` tells whether anything changed."""
    within = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), v.cast("double")))
    a, b, c, d = within(F.least(x0, x1)), within(F.least(y0, y1)), within(F.greatest(x0, x1)), within(F.greatest(y0, y1))
    changed = (a != x0.cast("double")) | (b != y0.cast("double")) | (c != x1.cast("double")) | (d != y1.cast("double"))
    box = F.struct(*[F.round(v).cast("int").alias(n) for v, n in ((a, "x0"), (b, "y0"), (c, "x1"), (d, "y1"))], changed.alias("repaired"))
    return F.when((a < c) & (b < d), box)


def type_hints(text: Column) -> Column:
    """Other source types that prose shows signs of, as array of source_type, label."""
    t = text_of(text)
    named = lambda kind, word, pattern: F.when(F.regexp_extract(t, pattern, 1) != "", F.struct(F.lit(kind).alias("source_type"), F.concat(F.lit(word), F.regexp_extract(t, pattern, 1)).alias("label")))
    plain = lambda kind, hit: F.when(hit, F.struct(F.lit(kind).alias("source_type"), F.lit("").alias("label")))
    found = F.array(
        F.coalesce(named("table", "Table ", r"(?i)\b(?:table|tab\.)\s*(\d+[A-Za-z]?)"), plain("table", F.size(F.regexp_extract_all(t, F.lit(r"\|"), 0)) >= 4)),
        named("figure", "Figure ", r"(?i)\b(?:figure|fig\.)\s*(\d+[A-Za-z]?)"),
        F.coalesce(named("equation_algorithm", "Algorithm ", r"(?i)\balgorithm\s*(\d+)"), named("equation_algorithm", "Equation ", r"(?i)\b(?:equation|eq\.)\s*\(?(\d+)\)?"), plain("equation_algorithm", F.size(F.regexp_extract_all(t, F.lit("[=∑∏∫≤≥]"), 0)) >= 2)),
        F.coalesce(named("citation_context", "", r"^\s*\[(\d{1,4})\]"), plain("citation_context", t.rlike(r"(?i)\breferences\b"))),
    )
    return F.filter(found, lambda h: h.isNotNull())
