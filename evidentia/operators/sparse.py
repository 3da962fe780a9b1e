"""Sums over the terms that documents and questions share: a document's terms are counted in its row, and its pairs with questions are summed where it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import dealt_by_size, staged
from .text import counted

#: Pairs of a document and a question that one task sums, terms that are looked up in a broadcast, and rows of questions that are broadcast.
PAIRS, FREQUENT, SMALL = 500_000, 50_000, 1_000_000
#: Rows of a file that is read to be dealt: of a document and a term, and of a document with all its terms.
TERM_ROWS, BAG_ROWS = 250_000, 2_000


def bags(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """key, len, terms: the number of a document's words, and each different one with its count (term, n). Written once."""
    cut = docs.select(key, words.alias("_w"))
    return staged(cut.select(key, F.size("_w").cast("long").alias("len"), counted(F.col("_w")).alias("terms")), "bags", BAG_ROWS)


def written(rows: DataFrame) -> DataFrame:
    """Rows of a document and a term, written once in files of bounded rows."""
    return staged(rows, "postings", TERM_ROWS)


def words_of(held: DataFrame, *keep: str) -> DataFrame:
    """keep, term, n: a row for each different word of a bag."""
    return held.select(*keep, F.explode("terms").alias("_x")).select(*keep, "_x.term", "_x.n")


def document_counts(held: DataFrame) -> DataFrame:
    """term, df. Written once."""
    return staged(words_of(held).groupBy("term").agg(F.count("*").alias("df")), "counts")


def of_terms(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of counts whose term some row of asked has."""
    return counts.join(asked.select("term").distinct(), "term", "left_semi")


def sums_of(held: DataFrame, counts: DataFrame, key: str, part: Column) -> DataFrame:
    """key, norm: part (of n, len, df) summed over all of a document's terms.

    The FREQUENT most frequent terms, which are most of the words, are looked up where a document is; only the others meet their counts by a shuffle.
    """
    often = staged(counts.orderBy(F.desc("df"), "term").limit(FREQUENT), "frequent")
    words = words_of(held, key, "len")
    here = words.join(F.broadcast(often), "term").groupBy(key).agg(F.sum(part).alias("norm"))
    seldom = words.join(F.broadcast(often.select("term")), "term", "left_anti").join(counts, "term").groupBy(key).agg(F.sum(part).alias("norm"))
    return here.unionByName(seldom).groupBy(key).agg(F.sum("norm").alias("norm"))


def shared(held: DataFrame, asked: DataFrame, *, key: str, pairs: int, words: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of held and asked (query, term, ...) that share a term, dealt by document, so that grouping them by pair moves none and a task holds about PAIRS pairs.

    held is bags, or what `words` makes rows with a term of. Questions of more than SMALL rows are not broadcast.
    """
    rows = dealt_by_size(held, pairs, PAIRS, key)
    rows = words(rows) if words else words_of(rows, key, "len")
    return rows.join(F.broadcast(asked) if asked.count() <= SMALL else asked, "term")
