"""Tokenizers, normalisers and mention extractors as column expressions. Null counts as the empty text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Patterns and word lists that results depend on.
METHOD = r"\b(?:[A-Z][A-Za-z0-9]*(?:[-²][A-Za-z0-9]+)+|[A-Z]{2,}[A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*|[a-z][A-Z]{2,}[A-Za-z0-9-]*)\b"
MIXED_METHOD = r"\b(?:[0-9]+[A-Za-z][A-Za-z0-9.-]*|[A-Za-z]+[0-9][A-Za-z0-9.-]*|[A-Z]?[a-z][A-Z]{1,}[A-Za-z0-9.-]*)\b"
QUOTED = r"['\"]([^'\"]{2,80})['\"]"
NAMED_PAPER = r"\b(?:the|a|an)\s+([A-Z][A-Za-z0-9².-]{2,}(?:\s+[A-Z][A-Za-z0-9².-]{2,}){0,4})\s+paper\b"
VENUES = ("ACL", "NAACL", "EMNLP", "CVPR", "ICCV", "ECCV", "ICLR", "ICML", "NeurIPS")
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "paper", "papers", "the", "to", "via",
    "what", "which", "with",
)
NON_METHOD_TERMS = (
    "aime", "alpacaeval", "ap", "arkitscenes", "bench2drive", "cifar10", "coco", "dfid", "fid", "geneval", "gpu", "hypersim", "imagenet", "ipc",
    "kit", "kitti", "llava1", "llm", "modelnet40", "naturalq", "nuscenes", "objectron", "pope", "qwen", "rgbd", "rtdetrv2r50", "studentt", "sun",
    "tinyimagenet", "vlm", "vlmbased",
)
MAX_MENTIONS = 16


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z0-9]+"), 0)


def content_tokens(text: Column) -> Column:
    """Different tokens of more than two characters."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 2))


def budget_tokens(text: Column) -> Column:
    """Number of white-space tokens, as unit budgets count them."""
    return F.size(F.filter(F.split(text_of(text), r"\s+"), lambda t: t != "")).cast("long")


def compact(text: Column) -> Column:
    """Letters and digits only, superscript two and three as digits."""
    return F.regexp_replace(F.lower(F.translate(text_of(text), "²³", "23")), "[^a-z0-9]+", "")


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text_of(text), r"https?://\S+", "[URL_REMOVED]")


def title_words(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def acronym(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def window_acronyms(words: Column, least: int = 2, most: int = 6) -> Column:
    """Different initialisms of all runs of two to six neighbouring words, sorted."""
    starts = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: acronym(F.slice(words, i, n))))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(starts(n), F.array().cast("array<string>")) for n in range(least, most + 1)]))))


def upper_aliases(text: Column) -> Column:
    """Compacted method-like names (capitals, camel case, hyphens) of 2 to 30 characters, sorted."""
    found = F.regexp_extract_all(text_of(text), F.lit(METHOD), 0)
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda m: F.length(m).between(2, 30)), compact)))


def query_terms(question: Column, *, filtered: bool = True) -> Column:
    """Compacted method-like, mixed, quoted and named-paper terms; without generic dataset names unless unfiltered. Sorted."""
    q = text_of(question)
    part = lambda pattern, group, least, most: F.filter(F.transform(F.regexp_extract_all(q, F.lit(pattern), group), compact), lambda t: F.length(t).between(least, most))
    top = 10**6 if filtered else 30
    parts = [part(METHOD, 0, 2, top), part(MIXED_METHOD, 0, 3, 10**6), part(QUOTED, 1, 1 if filtered else 2, top)]
    if filtered:
        parts.append(part(NAMED_PAPER, 1, 1, top))
    found = F.array_distinct(F.concat(*parts))
    return F.array_sort(F.array_except(found, _list(NON_METHOD_TERMS)) if filtered else found)


def query_mentions(question: Column) -> Column:
    """The first 16 different mentions in the order method, mixed, quoted; what they compact to tells them apart."""
    q = text_of(question)
    found = F.concat(*[F.transform(F.regexp_extract_all(q, F.lit(p), g), lambda m: F.trim(m)) for p, g in ((METHOD, 0), (MIXED_METHOD, 0), (QUOTED, 1))])
    keyed = F.filter(F.transform(found, lambda m: F.struct(compact(m).alias("key"), m.alias("mention"))), lambda m: (F.length(m["key"]) >= 3) & ~m["key"].isin(*NON_METHOD_TERMS))
    first = F.filter(keyed, lambda m, i: ~F.exists(F.slice(keyed, 1, i), lambda o: o["key"] == m["key"]))
    return F.slice(F.transform(first, lambda m: m["mention"]), 1, MAX_MENTIONS)


def _venue(name: Column) -> Column:
    return F.when(F.upper(name) == "NEURIPS", F.lit("NeurIPS")).otherwise(F.upper(name))


def venue_hints(question: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text_of(question), F.lit(rf"(?i)\b({'|'.join(VENUES)})\b"), 1), _venue)))


def year_hints(question: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text_of(question), F.lit(r"\b(20[0-9]{2})\b"), 1)))


def adjacent_venue_years(question: Column) -> Column:
    """`VENUE YEAR` and `YEAR VENUE` mentions as sorted array of `VENUE|YEAR`."""
    names = "|".join(VENUES)
    found = F.regexp_extract_all(text_of(question), F.lit(rf"(?i)\b(?:{names})\s+20[0-9]{{2}}\b|\b20[0-9]{{2}}\s+(?:{names})\b"), 0)
    pair = lambda m: F.concat(_venue(F.regexp_extract(m, rf"(?i)({names})", 1)), F.lit("|"), F.regexp_extract(m, "(20[0-9]{2})", 1))
    return F.array_sort(F.array_distinct(F.transform(found, pair)))


def normalize_answer(text: Column) -> Column:
    """Trimmed, lower case, without quotes around, single spaces."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text_of(text), r"^\s+|\s+$", "")), "^[\"'“”‘’`]+|[\"'“”‘’`]+$", "")
    return F.regexp_replace(bare, r"\s+", " ")


def normalize_number(text: Column) -> Column:
    """A number without percent signs; null if it is none. Thousands separators are not read."""
    return F.regexp_replace(F.trim(text_of(text)), "%", "").try_cast("double")


def coerce_number(text: Column) -> Column:
    """A number without thousands separators and a unit behind it; null if it is none."""
    bare = F.regexp_extract(F.trim(text_of(text)), r"^([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*[A-Za-z%°µ/]*$", 1)
    return F.nullif(F.regexp_replace(bare, ",", ""), F.lit("")).try_cast("double")


def clip(text: Column, limit: int) -> Column:
    """Single spaces, at most limit characters, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text_of(text), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def page_text(text: Column) -> Column:
    """Extracted page text without NULs, with short runs of blanks and line ends."""
    flat = F.regexp_replace(F.regexp_replace(text_of(text), "\x00", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(flat, r"\n{3,}", "\n\n"))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared content tokens over the smaller set; 0 if either is empty."""
    x, y = content_tokens(a), content_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)).cast("double"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 0 if either is empty or nothing is shared."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when((F.size(x) == 0) | (F.size(y) == 0) | (both == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def decimal_text(value: Column) -> Column:
    """Plain decimal digits without trailing zeros."""
    shown = value.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(shown, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def sentences(text: Column) -> Column:
    """Sentences: cut behind `.`, `!` or `?` and white space, and at line ends; empty ones dropped."""
    marked = F.regexp_replace(text_of(text), r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda x: F.trim(x)), lambda s: s != "")


# What a table's text looks like, and headings of papers.
_NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?"
_METRIC = r"(?i)(?:#|%|↑|↓|±|✓|AP(?:val|50|75|s|m|l)?\b|FID\b|F1\b|Acc\.?|Params?\.?|GFLOPs?|FLOPs?|Latency|Epochs?|Method\s+.*\b(?:AP|Acc|F1|Params|GFLOPs?)\b)"
_HEADINGS = (
    "abstract", "introduction", "related work", "related works", "background", "preliminaries", "method", "methods", "methodology", "approach", "framework",
    "data", "dataset", "data construction", "training", "training objective", "optimization", "experiments", "experimental setup",
    "implementation details", "evaluation", "results", "analysis", "ablation", "discussion", "conclusion", "limitations", "ethics statement",
    "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "broader impact", "broader impacts", "references",
    "bibliography", "appendix", "supplementary material", "supplementary",
)


def table_like(text: Column) -> Column:
    """Whether a line looks like a table's: an @, two numbers, a metric among three words, or mostly short words."""
    flat = F.trim(F.regexp_replace(text_of(text), r"\s+", " "))
    parts = F.split(flat, " ")
    short = F.size(F.filter(parts, lambda w: F.length(w) <= 4)) / F.size(parts).cast("double")
    numbers = F.size(F.regexp_extract_all(flat, F.lit(_NUMBER), 0))
    return (flat != "") & (flat.contains("@") | (numbers >= 2) | (flat.rlike(_METRIC) & (F.size(parts) >= 3)) | ((F.size(parts) >= 5) & (short > 0.65)))


def section_heading(text: Column) -> Column:
    """Whether a line is a first-level heading of a paper: a usual title, numbered or not, or an appendix; short, no final period, no table text."""
    flat = F.trim(F.regexp_replace(text_of(text), r"\s+", " "))
    titled = F.lower(flat).rlike(rf"^(?:[1-9]\d*\s*[.)]?\s+)?(?:{'|'.join(_HEADINGS)})$") | flat.rlike(r"(?i)^(?:Appendix\s+[A-Z]|[A-Z]\s+Appendix)$")
    return (F.length(flat) <= 64) & ~flat.endswith(".") & ~table_like(flat) & titled


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value made once a row, however often and in however many lambdas `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
