"""Evidence hierarchy: catalog, contexts, cards, navigation, opaque keys, and what resolves through them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import labels as L, text as T
from .scoring import rank_by


# How prose names objects, and what is a number of theirs.
_NUMBER = r"(?:[A-Za-z]\.)?[0-9]+[A-Za-z]?(?:\.[0-9A-Za-z]+)*"
_LABEL = rf"(?i)^(table|figure|fig\.?|equation|eq\.?|algorithm)\s*\(?\s*({_NUMBER})\s*\)?$"
_SPOKEN = rf"(?i)(?<!\w)(table|tab\.?|figure|fig\.?|equation|eq\.?|algorithm|alg\.?)(?=\s*\(?\s*({_NUMBER})(?!\w))"


def label_key(label: Column) -> Column:
    """What a labelled object is called in prose: the first two letters of its word and its number, in lower case; null for labels that are none."""
    bare = F.trim(T.text_of(label))
    word, number = F.regexp_extract(bare, _LABEL, 1), F.regexp_extract(bare, _LABEL, 2)
    return F.when(word != "", F.lower(F.concat_ws(" ", F.substring(word, 1, 2), number)))


def spoken_keys(text: Column) -> Column:
    """The different keys of objects that a text speaks of. `Table 3.2.1` also speaks of tables 3.2 and 3."""
    told = lambda group: F.regexp_extract_all(T.text_of(text), F.lit(_SPOKEN), F.lit(group))
    least = lambda parts: F.when(F.get(parts, F.lit(0)).rlike("^[A-Za-z]$"), 2).otherwise(1)
    starts = lambda parts: F.transform(F.sequence(least(parts), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    keys = F.zip_with(told(1), told(2), lambda w, n: F.transform(starts(F.split(n, r"\.")), lambda x: F.lower(F.concat_ws(" ", F.substring(w, 1, 2), x))))
    return F.array_distinct(F.flatten(keys))


def narrations(anchors: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """paper_id, anchor, record_id, place: the k text records that speak of each anchor's label, same section first, then nearest by page and order.

    anchors and records: paper_id, record_id, section_id, page, at, label, kind, text. An anchor meets only the k + 1 nearest on either side of it in
    each of the k + 1 nearest sections and pages that speak of its label, so those that share a label are never all paired.
    """
    by, near = ["paper_id", "key", "cell"], k + 1
    a = anchors.select("paper_id", F.col("record_id").alias("anchor"), F.struct(F.col("section_id").alias("s"), F.col("page").alias("p")).alias("own"), F.col("at").alias("o"), label_key(F.col("label")).alias("key")).where("key is not null")
    told = records.where(F.col("kind") == "text_span").select("paper_id", F.explode(spoken_keys(F.col("text"))).alias("key"), F.struct("section_id", "page").alias("cell"), "at", "record_id")
    other, away = (~F.col("cell.section_id").eqNullSafe(F.col("own.s"))).cast("int"), F.abs(F.col("cell.page") - F.col("own.p"))
    cells = a.select("paper_id", "key", "own").distinct().join(told.select(*by).distinct(), ["paper_id", "key"])
    cells = cells.withColumn("_c", F.rank().over(W.partitionBy("paper_id", "key", "own").orderBy(F.asc(other), F.asc(away)))).where(F.col("_c") <= near).drop("_c")
    asks = a.join(cells, ["paper_id", "key", "own"])
    marks = asks.select(*by, F.col("o").alias("at"), F.struct("own", "o", "anchor").alias("ask"))
    both = told.select(*by, "at", F.lit(None).cast(marks.schema["ask"].dataType).alias("ask")).unionByName(marks)
    before = F.count(F.when(F.col("ask").isNull(), 1)).over(W.partitionBy(*by).orderBy(F.asc("at"), F.asc(F.col("ask").isNull())).rowsBetween(W.unboundedPreceding, W.currentRow))
    places = both.withColumn("_i", before).where("ask is not null")
    met = None
    for steps, order in (((1 - near, 0), F.desc("record_id")), ((1, near), F.asc("record_id"))):  # those before an anchor, and those at its place and behind
        rows = told.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(F.asc("at"), order)).cast("long"))
        side = places.select(*by, "ask", F.explode(F.sequence(F.col("_i") + steps[0], F.col("_i") + steps[1])).alias("_i")).join(rows, [*by, "_i"])
        met = side if met is None else met.unionByName(side)
    met = met.select("paper_id", "cell", "at", "record_id", "ask.*").where(F.col("record_id") != F.col("anchor"))
    order = [other, away, F.abs(F.col("at") - F.col("o")), F.col("cell.page"), F.col("at"), F.col("record_id")]
    return met.withColumn("place", rank_by(["paper_id", "anchor"], *[F.asc(c) for c in order])).where(F.col("place") <= k).select("paper_id", "anchor", "record_id", "place")


def catalog(selected: DataFrame) -> DataFrame:
    """selected (query_id, place, record_id, ...) with evidence_ref E0001, E0002, ... by place."""
    return selected.withColumn("evidence_ref", F.format_string("E%04d", rank_by(["query_id"], F.asc("place"), F.asc("record_id"))))


def extractive_cards(catalog: DataFrame, questions: DataFrame, k: int = 12, limit: int = 520) -> DataFrame:
    """query_id, card_key, evidence_ref, proposition, score: the k sentences that share most content words with the question, shorter ones first, each record once."""
    q = questions.select("query_id", T.content_tokens(F.col("question")).alias("q"))
    s = catalog.select("query_id", "evidence_ref", F.explode(T.sentences(F.col("text"))).alias("s")).join(q, "query_id")
    s = s.withColumn("score", F.size(F.array_intersect("q", F.array_distinct(T.tokens(F.col("s"))))))
    best = s.withColumn("rn", rank_by(["query_id", "evidence_ref"], F.desc("score"), F.asc(F.length("s")), F.asc("s"))).where("rn = 1 and score > 0")
    best = best.withColumn("place", rank_by(["query_id"], F.desc("score"), F.asc(F.length("s")), F.asc("evidence_ref"))).where(F.col("place") <= k)
    return best.select("query_id", F.format_string("C%03d", "place").alias("card_key"), "evidence_ref", T.clip(F.col("s"), limit).alias("proposition"), "score")


def resolve_claims(claims: DataFrame, cards: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, claim_id, card_key, evidence_ref, paper_id, record_id of claims (query_id, claim_id, keys); unknown keys have null evidence."""
    asked = claims.select("query_id", "claim_id", F.explode("keys").alias("card_key"))
    known = cards.select("query_id", "card_key", "evidence_ref").join(catalog.select("query_id", "evidence_ref", "paper_id", "record_id"), ["query_id", "evidence_ref"])
    return asked.join(known, ["query_id", "card_key"], "left")


def sufficiency(claims: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, missing, sufficient: claims (query_id, claim_id) without a card (query_id, claim_id)."""
    gone = claims.join(cards.select("query_id", "claim_id").distinct(), ["query_id", "claim_id"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_set("claim_id")).alias("missing"))
    return claims.select("query_id").distinct().join(gone, "query_id", "left").select("query_id", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), F.col("missing").isNull().alias("sufficient"))


def allowed_locators(evidence: DataFrame) -> DataFrame:
    """query_id, paper_id, kind and the sets of pages and labels that selected evidence (page, label, kind) allows."""
    return evidence.groupBy("query_id", "paper_id", "kind").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set(L.label(F.col("label"), F.col("kind")))).alias("labels"))


def restrict(predicted: DataFrame, allowed: DataFrame) -> DataFrame:
    """Predicted evidence (query_id, paper_id, kind, page, label) that the allowed sets know; pages and labels that are not in them become null."""
    rows = predicted.join(allowed, ["query_id", "paper_id", "kind"])
    return rows.select("query_id", "paper_id", "kind", F.when(F.array_contains("pages", F.col("page")), F.col("page")).alias("page"), F.when(F.array_contains("labels", L.label(F.col("label"), F.col("kind"))), F.col("label")).alias("label"))


def shape(catalog: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, records, cards, chars of records, chars of cards, compression, and whether every card has its record."""
    a = catalog.groupBy("query_id").agg(F.count("*").alias("records"), F.sum(F.length("text")).alias("record_chars"))
    b = cards.groupBy("query_id").agg(F.count("*").alias("cards"), F.sum(F.length("proposition")).alias("card_chars"))
    lost = cards.join(catalog.select("query_id", "evidence_ref"), ["query_id", "evidence_ref"], "left_anti").select("query_id").distinct().withColumn("_lost", F.lit(True))
    rows = a.join(b, "query_id", "left").join(lost, "query_id", "left").na.fill(0, ["cards", "card_chars"])
    return rows.select("query_id", "records", "cards", "record_chars", "card_chars", F.round(F.col("card_chars") / F.greatest(F.lit(1), "record_chars"), 6).alias("compression"), F.col("_lost").isNull().alias("valid"))
