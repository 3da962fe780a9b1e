"""Links, identifiers, page elements and pipe tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import text_of

# Patterns of identifiers and the order in which kinds of addresses are tried.
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)"
DOI = r"\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b"
FORUM = r"openreview\.net/[^?]*\?.*?id=([A-Za-z0-9_-]+)"
PRIORITY = {"direct": 1, "preprint": 2, "forum": 3, "doi": 4, "url": 5, "unknown": 9}


def links(html: Column) -> Column:
    return F.regexp_extract_all(text_of(html), F.lit('<a [^>]*href="([^"]*)"'), 1)


def title(html: Column) -> Column:
    return F.regexp_extract(text_of(html), "<title>([^<]*)</title>", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(text_of(url), r"^[a-z]+://([^/?#]*)", 1))


def is_direct_pdf(url: Column) -> Column:
    """Whether the path of an address names a PDF."""
    return F.lower(F.regexp_extract(text_of(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)).rlike(r"\.pdf$|/pdf")


def identifiers(text: Column) -> Column:
    """The first preprint id, DOI and forum id in a text."""
    one = lambda p: F.nullif(F.regexp_extract(text_of(text), p, 1), F.lit(""))
    return F.struct(one(ARXIV_URL).alias("arxiv_id"), one(DOI).alias("doi"), one(FORUM).alias("forum_id"))


def url_priority(url: Column) -> Column:
    """Smaller is tried first."""
    low = F.lower(text_of(url))
    return (
        F.when(low.contains("arxiv.org"), PRIORITY["preprint"])
        .when(low.contains("openreview.net"), PRIORITY["forum"])
        .when(low.contains("doi.org"), PRIORITY["doi"])
        .when(is_direct_pdf(url), PRIORITY["direct"])
        .when(text_of(url).rlike("^https?://"), PRIORITY["url"])
        .otherwise(PRIORITY["unknown"])
    )


def block_tags(html: Column) -> Column:
    """Names of the block elements of a page, in order."""
    return F.regexp_extract_all(text_of(html), F.lit("<(h[1-3]|p|li|td|th)[ >]"), 1)


def pipe_cells(line: Column) -> Column:
    """Cells of a line of a pipe table, with single spaces; outer pipes dropped."""
    bare = F.regexp_replace(F.trim(text_of(line)), r"^\||\|$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
