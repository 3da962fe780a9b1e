"""Source types, labels, locators and question targets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import normalize_answer, text_of

# The official domains and how other names map to them.
OFFICIAL_TYPES = ("text_span", "table", "figure", "equation_algorithm", "citation_context")
TYPE_OF_RECORD = {
    "title": "text_span",
    "section_header": "text_span",
    "paragraph": "text_span",
    "table": "table",
    "table_caption": "table",
    "figure": "figure",
    "figure_caption": "figure",
    "equation": "equation_algorithm",
    "equation_reference": "equation_algorithm",
    "algorithm": "equation_algorithm",
    "citation_context": "citation_context",
    "reference": "citation_context",
    "footer": "text_span",
    "header": "text_span",
    "header_footer": "text_span",
    "unknown": "text_span",
}
TYPE_ALIASES = {
    "paragraph": "text_span",
    "section_header": "text_span",
    "text": "text_span",
    "table_caption": "table",
    "figure_caption": "figure",
    "equation": "equation_algorithm",
    "algorithm": "equation_algorithm",
    "reference": "citation_context",
    "reference_entry": "citation_context",
}
SECTION_TYPES = (
    ("abstract", ("abstract",)),
    ("introduction", ("intro",)),
    ("related_work", ("related", "background", "preliminar")),
    ("method", ("method", "approach", "model", "framework", "training", "objective", "optimization")),
    ("experiments", ("experiment", "evaluation", "implementation", "setup")),
    ("results", ("result", "analysis", "ablation")),
    ("discussion", ("discussion",)),
    ("conclusion", ("conclusion",)),
    ("references", ("references", "bibliography")),
    ("appendix", ("appendix", "supplementary")),
    ("front_matter", ("front matter",)),
)
MULTI_PAPER = (
    r"\bacross (?:all|the) papers\b",
    r"\bwhich .* papers\b",
    r"\bwhat .* each\b",
    r"\blist\b.*\bpapers?\b",
    r"\bcompare[sd]?\b",
    r"\bamong\b.*\bpapers?\b",
    r"\brespectively\b",
)
NUMBERED_OBJECT = r"(?i)\b(table|figure|fig\.?|equation|eq\.?|algorithm)\s*\(?\s*(\d{1,4})\s*\)?"
NUMBERED_REFERENCE = r"(?i)\b\d{1,3}(?:st|nd|rd|th)\s+(?:reference|citation)\b"


def _case(pairs: dict[str, str], value: Column, default: Column) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(default)


def official_type(record_type: Column, source_type: Column) -> Column:
    """The official source type: the given one if it is official, else the record type's; null if neither is known."""
    own = F.trim(text_of(source_type))
    return F.when(own.isin(*OFFICIAL_TYPES), own).otherwise(_case(TYPE_OF_RECORD, F.trim(text_of(record_type)), F.lit(None).cast("string")))


def source_type(value: Column) -> Column:
    low = F.lower(F.trim(text_of(value)))
    return _case(TYPE_ALIASES, low, low)


def citation_id(value: Column) -> Column:
    """The number in `Reference 7`, `[7]` or `7`, without leading zeros; anything else trimmed as it is."""
    t = F.trim(text_of(value))
    ways = (r"(?i)\b(?:reference|ref\.?|citation)\s*\[?\s*(\d{1,4})\s*\]?", r"\[\s*(\d{1,4})\s*\]", r"^\s*(\d{1,4})\s*$")
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in ways])
    return F.coalesce(found.cast("int").cast("string"), t)


def label(value: Column, kind: Column) -> Column:
    """`Table n`, `Figure n`, `Algorithm n`, `Equation n` or `Reference n` by source type; other labels with single spaces."""
    t = F.trim(F.regexp_replace(text_of(value), r"\s+", " "))
    k = source_type(kind)
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in patterns])
    bare = lambda c: F.regexp_replace(c, r"[.,;:]+$", "")
    named = lambda word, *patterns: F.coalesce(F.concat(F.lit(f"{word} "), bare(first(*patterns))), t)
    equation = named("Equation", r"(?i)\b(?:equation|eq\.)\s*\(?([A-Za-z0-9.\-]+)\)?", r"^\(?([0-9]+[A-Za-z]?)\)?$")
    reference = first(r"(?i)\breference\s*([0-9]{1,4})\b", r"\[([0-9]{1,4})\]", r"(?i)\b([0-9]{1,4})(?:st|nd|rd|th)\s+reference\b", r"^\s*([0-9]{1,4})\s*$")
    return (
        F.when(k == "table", named("Table", r"(?i)\b(?:table|tab\.)\s*([A-Za-z0-9.\-]+)"))
        .when(k == "figure", named("Figure", r"(?i)\b(?:figure|fig\.)\s*([A-Za-z0-9.\-]+)"))
        .when(k == "equation_algorithm", F.coalesce(F.concat(F.lit("Algorithm "), bare(first(r"(?i)\balgorithm\s*([A-Za-z0-9.\-]+)"))), equation))
        .when(k == "citation_context", F.coalesce(F.concat(F.lit("Reference "), reference.cast("int").cast("string")), t))
        .otherwise(t)
    )


def grounding_kind(kind: Column, value: Column) -> Column:
    """The locator field that a label of this source type belongs in; null if there is none."""
    t = F.trim(text_of(value))
    return F.when(t == "", None).when(kind == "table", "table_id").when(kind == "figure", "figure_id").when((kind == "equation_algorithm") & F.lower(t).contains("algorithm"), "algorithm_id").when(kind == "equation_algorithm", "equation_id").when(kind == "citation_context", "citation_id")


def visible_id(value: Column, prefix: str) -> Column:
    """`<prefix> n` for `prefix n` or a bare number with at most one letter; other texts normalised as they are."""
    t = normalize_answer(value)
    number = F.nullif(F.regexp_extract(t, rf"^(?:{prefix}\s*)?(\d+[a-z]?)$", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit(f"{prefix} "), number), t)


def evidence_key(paper: Column, kind: Column, page: Column, section: Column, table_id: Column, figure_id: Column, equation_id: Column, algorithm_id: Column, cited: Column) -> Column:
    """paper, type, page or section, object id: what evidence is compared by. Page 0 counts as absent; bare algorithm numbers are equations."""
    k = F.trim(text_of(kind))
    place = F.coalesce(F.nullif(page.cast("long"), F.lit(0)).cast("string"), section)
    either = F.coalesce(F.nullif(text_of(equation_id), F.lit("")), algorithm_id)
    thing = F.when(k == "table", visible_id(table_id, "table")).when(k == "figure", visible_id(figure_id, "figure")).when(k == "equation_algorithm", visible_id(either, "equation")).when(k == "citation_context", visible_id(cited, "citation")).otherwise("")
    return F.struct(F.trim(text_of(paper)).alias("paper_id"), k.alias("source_type"), F.trim(text_of(place)).alias("location"), thing.alias("object_id"))


def section_type(title: Column) -> Column:
    """The section family of a heading, by the first family one of whose words it contains; numbering is ignored."""
    low = F.lower(F.regexp_replace(F.trim(text_of(title)), r"^\d+(?:\.\d+)*\.?\s+", ""))
    out = None
    for name, parts in SECTION_TYPES:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def numbered_types(question: Column) -> Column:
    """Different source types that a question names with a number, in order; a numbered reference comes last."""
    words = F.transform(F.regexp_extract_all(text_of(question), F.lit(NUMBERED_OBJECT), 1), lambda w: F.rtrim(F.lower(w)))
    types = F.transform(words, lambda w: F.when(w == "table", "table").when(w.startswith("fig"), "figure").otherwise("equation_algorithm"))
    cited = F.when(text_of(question).rlike(NUMBERED_REFERENCE), F.array(F.lit("citation_context"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(types, cited))


def is_multi_paper(question: Column) -> Column:
    low = F.lower(text_of(question))
    hit = F.lit(False)
    for p in MULTI_PAPER:
        hit = hit | low.rlike(p)
    return hit


# What plans and callers call source types, and the bounds of a plan's numbers and lists.
TYPE_NAMES = {
    "text": "text_span",
    "paragraph": "text_span",
    "citation": "citation_context",
    "cited": "citation_context",
    "reference": "citation_context",
    "equation": "equation_algorithm",
    "eq": "equation_algorithm",
    "algorithm": "equation_algorithm",
    "fig": "figure",
    "figs": "figure",
    "tab": "table",
    "tables": "table",
    "figures": "figure",
    "equations": "equation_algorithm",
}
MOST_PAPERS, MOST_TARGETS, MOST_ENTITIES = 50, 8, 16


def source_types(names: Column) -> Column:
    """Different official types among names (an array), aliases resolved, in order; others are dropped."""
    one = lambda x: F.trim(_case(TYPE_NAMES, F.lower(F.trim(text_of(x))), text_of(x)))
    return F.array_distinct(F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), one), lambda k: k.isin(*OFFICIAL_TYPES)))


def _listed(values: Column, most: int) -> Column:
    """Different texts that aren't blank, in order, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(text_of(x))), lambda x: x != "")), 1, most)


def task_structure(question: Column, slot_types: Column, paper_count: Column, targets: Column, entities: Column, cross_paper: Column, plan_cross_paper: Column) -> Column:
    """multi_paper, types, primary, family, paper_count, targets and entities of a task: what its plan says first, what the question says where the plan is silent.

    slot_types: all types that the plan's slots require; cross_paper: the analysis's word, plan_cross_paper: the checked plan's, which wins if true. A
    number of papers outside 1 to MOST_PAPERS counts for nothing. Several papers: two or more by number or targets, a synthesis over named entities, or such a question.
    """
    own = F.array_distinct(F.filter(F.transform(F.coalesce(slot_types, F.array().cast("array<string>")), lambda x: F.trim(text_of(x))), lambda k: k.isin(*OFFICIAL_TYPES)))
    types = F.when(F.size(own) > 0, own).otherwise(numbered_types(question))
    count = F.when(paper_count.between(1, MOST_PAPERS), paper_count).cast("int")
    shown, named = _listed(targets, MOST_TARGETS), _listed(entities, MOST_ENTITIES)
    cross = F.coalesce(F.when(plan_cross_paper, True), cross_paper, plan_cross_paper, F.lit(False))
    several = F.coalesce(count >= 2, F.lit(False)) | (F.size(shown) >= 2) | (cross & (F.size(named) > 0)) | is_multi_paper(question)
    return F.struct(several.alias("multi_paper"), types.alias("types"), F.coalesce(F.get(types, F.lit(0)), F.lit("")).alias("primary"), F.when(several, "multi_paper").otherwise("single_paper").alias("family"), count.alias("paper_count"), shown.alias("targets"), named.alias("entities"))


def operation(question: Column) -> Column:
    """count, difference, maximum, minimum or direct: what a question asks to do with values."""
    low = F.lower(text_of(question))
    return (
        F.when(low.rlike(r"\bhow many\b|\bnumber of\b|\bcount\b"), "count")
        .when(low.rlike(r"\bdifference\b|\bhow much (?:higher|lower|more|less|better)\b|\bimprovement\b"), "difference")
        .when(low.rlike(r"\bhighest\b|\bmaximum\b|\bbest\b|\blargest\b|\bmost\b"), "maximum")
        .when(low.rlike(r"\blowest\b|\bminimum\b|\bsmallest\b|\bleast\b"), "minimum")
        .otherwise("direct")
    )


def targets(question: Column) -> Column:
    """Numbers of the table, figure, equation, algorithm and reference that a question names, and whether it means the last reference."""
    q = text_of(question)
    number = lambda p: F.nullif(F.regexp_extract(q, p, 1), F.lit(""))
    return F.struct(
        number(r"(?i)\btable\s*(\d+[A-Za-z]?)").alias("table_id"),
        number(r"(?i)\bfig(?:ure|\.)?\s*(\d+[A-Za-z]?)").alias("figure_id"),
        number(r"(?i)\beq(?:uation|\.)?\s*\(?(\d+)\)?").alias("equation_id"),
        number(r"(?i)\balgorithm\s*(\d+)").alias("algorithm_id"),
        F.coalesce(number(r"(?i)\breference\s*\[?(\d+)\]?"), number(r"(?i)\b(\d+)(?:st|nd|rd|th)\s+(?:reference|citation)\b")).alias("citation_id"),
        F.lower(q).rlike(r"\blast (?:reference|citation)\b|\bfinal reference\b").alias("last_reference"),
    )


def object_label(question: Column) -> Column:
    """Labels like `table 3` that a question names, sorted."""
    found = F.regexp_extract_all(text_of(question), F.lit(NUMBERED_OBJECT), 0)
    one = lambda m: F.concat(F.when(F.lower(m).startswith("fig"), "figure").when(F.lower(m).startswith("eq"), "equation").when(F.lower(m).startswith("t"), "table").otherwise("algorithm"), F.lit(" "), F.regexp_extract(m, r"(\d{1,4})", 1))
    return F.array_sort(F.array_distinct(F.transform(found, one)))


def cell_equal(gold: Column, pred: Column, kind: Column) -> Column:
    """Typed equality of table cells given as texts: numbers within 1e-6, booleans by being non-empty, texts normalised; null only equals null."""
    from .text import normalize_number

    a, b = normalize_number(gold), normalize_number(pred)
    close = F.coalesce(F.abs(a - b) <= F.greatest(F.lit(1e-6) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-6)), F.lit(False))
    typed = F.when(kind == "number", close).when(kind == "boolean", (gold != "") == (pred != "")).otherwise(normalize_answer(gold) == normalize_answer(pred))
    return F.when(gold.isNull() | pred.isNull(), gold.isNull() & pred.isNull()).otherwise(typed)


# Venues a paper's source may be, in the order in which they are looked for.
SOURCE_VENUES = ("ACL", "EMNLP", "NAACL", "ICML", "NeurIPS", "ICLR", "CVPR", "ICCV", "ECCV")


def is_openreview(url: Column, venue: Column) -> Column:
    return F.lower(F.concat_ws(" ", venue, url)).contains("openreview.net")


def paper_source(url: Column, venue: Column) -> Column:
    """Where a paper is from: OpenReview, arXiv or the first venue that its venue or address names, else the address's host, else `unknown`."""
    low = F.lower(F.concat_ws(" ", venue, url))
    out = F.when(is_openreview(url, venue), "OpenReview").when(low.contains("arxiv.org"), "arXiv")
    for v in SOURCE_VENUES:
        out = out.when(low.contains(v.lower()), v)
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z]+://([^/?#]*)", 1))
    return out.when(host != "", host).otherwise("unknown")


def without_openreview(papers: DataFrame) -> DataFrame:
    """papers (url, venue) that are from elsewhere."""
    return papers.where(~is_openreview(F.col("url"), F.col("venue")))
