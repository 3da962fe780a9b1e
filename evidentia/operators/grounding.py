"""Answers held against evidence: choices, facts, quotes, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

# The closed set of relations and how others map to it.
PREDICATES = ("reports", "compares", "outperforms", "underperforms", "uses", "defines", "evaluates", "cites", "optimizes", "contains", "measures", "states")
PREDICATE_WORDS = (
    (r"\b(?:score|achiev|obtain|perform|result|value|has)\b", "reports"),
    (r"\b(?:higher|lower|better|worse|greater|less|difference|delta)\b", "compares"),
    (r"\b(?:introduc|propose|present|define)\b", "defines"),
    (r"\buse(?:s|d)?\b", "uses"),
)
NUMBER = r"[-+]?\d+(?:\.\d+)?"
CARD_OVERLAP, RELATION_OVERLAP = 0.42, 0.45
LEAST_SUPPORT, LEAST_MARGIN = 10.0, 4.0


def flat(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(T.text_of(text)), r"\s+", " "))


def predicate(value: Column) -> Column:
    low = flat(value)
    out = F.when(low.isin(*PREDICATES), low)
    for pattern, name in PREDICATE_WORDS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("")


def infer_choice(raw: Column, freeform: Column, options: Column) -> Column:
    """The key of the option (array of key, text) that an answer means: its letter, a letter in it that is a key, or a text that equals or contains the other. Empty if none."""
    up = F.upper(F.trim(T.text_of(raw)))
    by_key = lambda k: F.get(F.filter(options, lambda o: F.upper(o["key"]) == k), F.lit(0))["key"]
    letter = F.regexp_extract(up, r"\b(?:OPTION|ANSWER|CHOICE)?\s*([A-Z])\b", 1)
    near = lambda c: F.get(F.filter(options, lambda o: (flat(c) != "") & (flat(o["text"]) != "") & (flat(o["text"]).contains(flat(c)) | flat(c).contains(flat(o["text"])))), F.lit(0))["key"]
    return F.coalesce(by_key(up), by_key(letter), near(raw), near(freeform), F.lit(""))


def option_support(option: Column, evidence: Column, question: Column) -> Column:
    """How well evidence supports an option: contained 10 and up to 5 for length, shares of its words 3 and of those not in the question 2, each number 2."""
    bare = lambda c: F.trim(F.regexp_replace(F.lower(T.text_of(c)), "[^a-z0-9.]+", " "))
    o, e, q = (F.array_distinct(T.tokens(c)) for c in (option, evidence, question))
    own = F.array_except(o, q)
    share = lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, e)) / F.greatest(F.size(a), F.lit(1)))
    numbers = F.size(F.filter(F.regexp_extract_all(T.text_of(option), F.lit(NUMBER), 0), lambda n: F.array_contains(F.regexp_extract_all(T.text_of(evidence), F.lit(r"\d+(?:\.\d+)?"), 0), F.regexp_replace(n, r"^[-+]", ""))))
    inside = F.when((bare(option) != "") & bare(evidence).contains(bare(option)), 10.0 + F.least(F.lit(5.0), F.length(bare(option)) / 20.0)).otherwise(0.0)
    return inside + 3.0 * share(o) + 2.0 * share(own) + 2.0 * numbers


def choice_by_support(scored: DataFrame, by: str) -> DataFrame:
    """by, key of the best supported option where it has enough support and a clear lead. scored: by, key, support."""
    w = W.partitionBy(by).orderBy(F.desc("support"), F.desc("key"))
    rows = scored.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("support").over(w), F.lit(-999.0)))
    return rows.where((F.col("_rn") == 1) & (F.col("support") >= LEAST_SUPPORT) & (F.col("support") - F.col("_next") >= LEAST_MARGIN)).select(by, "key")


def fact_supported(value: Column, evidence: Column) -> Column:
    """Contained as it is; else all its numbers are there; else its words of three letters or more stand there in a row."""
    claim, source = flat(value), flat(evidence)
    numbers = F.regexp_extract_all(claim, F.lit(NUMBER), 0)
    words = F.array_join(F.filter(T.tokens(claim), lambda t: F.length(t) >= 3), " ")
    return F.when((claim == "") | (source == ""), False).when(source.contains(claim), True).when(F.size(numbers) > 0, F.size(F.array_except(numbers, F.regexp_extract_all(source, F.lit(NUMBER), 0))) == 0).otherwise((words != "") & F.array_join(T.tokens(source), " ").contains(words))


def grounded(proposition: Column, quote: Column, record: Column, least: float = CARD_OVERLAP) -> Column:
    """Whether a proposition is extractive: its quote stands in the record, and its numbers, named entities and enough of its words in the quote."""
    numbers = F.regexp_extract_all(T.text_of(proposition), F.lit(NUMBER), 0)
    names = F.filter(F.regexp_extract_all(T.text_of(proposition), F.lit(T.METHOD), 0), lambda n: F.length(n) > 2)
    words = F.array_distinct(T.tokens(proposition))
    share = F.size(F.array_intersect(words, F.array_distinct(T.tokens(quote)))) / F.greatest(F.lit(1), F.size(words))
    inside = (flat(quote) != "") & flat(record).contains(flat(quote))
    return inside & F.forall(numbers, lambda n: F.contains(T.text_of(quote), n)) & F.forall(names, lambda n: F.contains(F.lower(T.text_of(quote)), F.lower(n))) & (share >= least)


def triple_graph(triples: DataFrame, k: int = 4) -> DataFrame:
    """claim_id, entity, triples: for each claim and entity the first k triples (triple_id, claim_id, subject, object)."""
    ends = triples.select("claim_id", "triple_id", F.explode(F.array_distinct(F.array(flat(F.col("subject")), flat(F.col("object"))))).alias("entity"))
    return ends.where("entity <> ''").groupBy("claim_id", "entity").agg(F.slice(F.array_sort(F.collect_set("triple_id")), 1, k).alias("triples"))
