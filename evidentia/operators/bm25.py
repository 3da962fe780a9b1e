"""Okapi BM25 as joins and aggregates over exploded terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import staged
from . import sparse
from .text import counted, tokens


def bm25_scores(docs: DataFrame, queries: DataFrame, *, doc_key: str, query_key: str, doc_text: str = "text", query_text: str = "text", k1: float = 1.5, b: float = 0.75, weight: float = 1.0) -> DataFrame:
    """query, document, score (rounded to 6 places) of every pair that shares a term.

    A term that a query repeats counts each time. Document length is at least 1. The question terms filter the corpus
    before the shuffle, so what moves follows the questions' vocabulary rather than the corpus.
    """
    asked = queries.select(query_key, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    sized = docs.select(doc_key, F.col(doc_text), F.size(tokens(F.col(doc_text))).cast("long").alias("len"))
    stats = sized.agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    exploded = sized.select(doc_key, "len", F.explode(tokens(F.col(doc_text))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    tf = exploded.groupBy(doc_key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("avgdl"))
    scored = asked.join(idf, "term").join(tf, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * ((1.0 - b) + b * F.greatest(F.lit(1), F.col("len")) / F.greatest(F.col("avgdl"), F.lit(1e-9))))
    return scored.groupBy(query_key, doc_key).agg(F.round(F.sum(part) * weight, 6).alias("score"))


def top_k(scores: DataFrame, k: int, *, query_key: str, doc_key: str) -> DataFrame:
    """The k best rows of each query by score, ties to the smaller key, with their rank."""
    order = W.partitionBy(query_key).orderBy(F.desc("score"), F.asc(doc_key))
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


#: Terms are joined until what the others can add is at most so much of what all can; and how much rounded scores may differ.
LEFT_OUT, MARGIN = 1 / 8, 2e-6


@dataclass(frozen=True)
class Postings:
    """What scores are made of: rows (document, term, impact) of asked terms, and weights (query, term, weight, rest, before, strong), and how many pairs there can be.

    weight * impact is a term's part of a document's score; rest is the most that the terms behind it can add, before that and its own, where a
    query's terms stand by what they can add at most. Strong terms are those before which more than LEFT_OUT of all is left.
    """

    rows: DataFrame
    weights: DataFrame
    doc_key: str
    query_key: str
    pairs: int


def term_counts(docs: DataFrame, asked: DataFrame, *, doc_key: str, text: str = "text") -> DataFrame:
    """document, len, term, tf of the terms in `asked`. Texts are cut once and counted in their row, so no word is shuffled."""
    sized = docs.select(doc_key, tokens(F.col(text)).alias("_t")).select(doc_key, F.size("_t").alias("len"), F.explode(counted(F.col("_t"))).alias("_x"))
    return sized.select(doc_key, "len", "_x.term", F.col("_x.n").alias("tf")).join(asked.select("term").distinct(), "term", "left_semi").select(doc_key, "len", "term", "tf")


def postings(docs: DataFrame, queries: DataFrame, *, doc_key: str, query_key: str, doc_text: str = "text", query_text: str = "text", k1: float = 1.5, b: float = 0.75) -> Postings:
    """Written once: the postings of the terms that some query asks, and the queries' weights."""
    asked = queries.select(query_key, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    sized = docs.select(doc_key, tokens(F.col(doc_text)).alias("_t"))
    n, total = sized.agg(F.count("*"), F.sum(F.size("_t"))).first()
    mean = max((total or 0) / max(n, 1), 1e-9)
    tf = term_counts(docs, asked, doc_key=doc_key, text=doc_text)
    impact = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * ((1.0 - b) + b * F.greatest(F.lit(1), F.col("len")) / mean))
    rows = staged(tf.select(doc_key, "term", impact.alias("impact")), "postings", sparse.TERM_ROWS)
    terms = rows.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"))
    weight = F.col("qtf") * F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(terms, "term").select(query_key, "term", weight.alias("weight"), (weight * F.col("top")).alias("bound"))
    order = W.partitionBy(query_key).orderBy(F.desc("bound"), "term")
    behind, every = F.coalesce(F.sum("bound").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0)), F.sum("bound").over(W.partitionBy(query_key))
    weights = weights.withColumn("rest", behind).withColumn("before", F.col("rest") + F.col("bound")).withColumn("strong", F.col("before") > LEFT_OUT * every).drop("bound")
    return Postings(rows, staged(weights, "weights"), doc_key, query_key, n * queries.count())


def scored(p: Postings, pairs: DataFrame, weight: float = 1.0) -> DataFrame:
    """query, document, score of given pairs, as bm25_scores() has it."""
    parts = pairs.join(p.weights.select(p.query_key, "term", "weight"), p.query_key).join(p.rows.select(p.doc_key, "term", "impact"), [p.doc_key, "term"])
    return parts.groupBy(p.query_key, p.doc_key).agg(F.round(F.sum(F.col("weight") * F.col("impact")) * weight, 6).alias("score"))


def _met(p: Postings, weights: DataFrame) -> DataFrame:
    """Rows of p with the weights of their term. A document's are in one task, so grouping them by pair shuffles no pair."""
    return sparse.shared(p.rows, weights, key=p.doc_key, pairs=p.pairs, words=lambda rows: rows)


def candidates(p: Postings, k: int) -> DataFrame:
    """query, document of every pair that can be among a query's k best, and few others.

    Parts of strong terms are summed first. The k best by these are scored in full, and the least of those scores is one that the k-th best
    reaches: pairs whose sum and what the other terms can add stay below are left out, and so are documents without a strong
    term. Where the other terms could add more than half of it, terms are joined until they can't; where fewer than k documents share a strong term, all.
    """
    key, doc = p.query_key, p.doc_key
    strong = p.weights.where("strong")
    part = staged(_met(p, strong.select(key, "term", "weight")).groupBy(key, doc).agg(F.sum(F.col("weight") * F.col("impact")).alias("score")), "parts")
    seeds = top_k(part, k, query_key=key, doc_key=doc)
    least = scored(p, seeds.select(key, doc)).groupBy(key).agg(F.when(F.count("*") >= k, F.min("score") - MARGIN).alias("least"))
    limits = staged(strong.groupBy(key).agg(F.min("rest").alias("rest")).join(least, key, "left").withColumn("told", F.coalesce(F.col("least") > 2 * F.col("rest"), F.lit(False))), "limits")
    near = part.join(limits.where("told"), key).where(F.col("score") + F.col("rest") >= F.col("least")).select(key, doc)
    goal = limits.where("NOT told").select(key, F.coalesce("least", F.lit(-1.0)).alias("least"))
    more = p.weights.join(goal, key).where(F.col("before") > F.col("least") / 2)  # now that the goal is known: terms until the rest is half of it
    deep = _met(p, more).groupBy(key, doc).agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    ends = more.groupBy(key).agg(F.min("rest").alias("rest"), F.first("least").alias("least"))
    return near.unionByName(deep.join(ends, key).where(F.col("score") + F.col("rest") >= F.col("least")).select(key, doc))


def every(p: Postings) -> DataFrame:
    """query, document, score of every pair that shares a term of p. A document's pairs are summed in one task."""
    parts = _met(p, p.weights.select(p.query_key, "term", "weight"))
    return parts.groupBy(p.query_key, p.doc_key).agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"))


def best(p: Postings, k: int) -> DataFrame:
    """The rows of top_k() over every(): of a task only its k best for each query leave it. The rows of p may be those of some documents only."""
    return top_k(every(p), k, query_key=p.query_key, doc_key=p.doc_key)


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, *, doc_key: str, query_key: str, **how) -> DataFrame:
    """The rows of top_k() over bm25_scores(), of which no pair is shuffled that can't be among the k best of its task."""
    return best(postings(docs, queries, doc_key=doc_key, query_key=query_key, **how), k)
