"""Claims against units and sections; table answers under their schema; records of a page made regular."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import labels as L, text as T
from .scoring import min_max, rank_by
from .tables import match_columns
from .transcription import is_placeholder


def fused_sections(claim_scores: DataFrame, sections: DataFrame, *, own: float = 0.6, claims: float = 0.4) -> DataFrame:
    """query_id, section_id, fused, place: section scores mixed with what claims say of them.

    claim_scores: query_id, claim_id, types (wanted source types), unit_id, section_id, kind, score; sections: query_id,
    section_id, score, rank. A claim looks at units of its types (at all where it has none of them), scaled within the
    claim; a section has the largest value of its units and claims, 0 without any. Ties keep the sections' rank.
    """
    w = W.partitionBy("query_id", "claim_id")
    rows = claim_scores.withColumn("_own", F.coalesce(F.array_contains("types", F.col("kind")), F.lit(False))).withColumn("_any", F.max("_own").over(w)).where(F.col("_own") | ~F.col("_any"))
    rows = rows.withColumn("_v", min_max("score", ["query_id", "claim_id"]))
    best = rows.groupBy("query_id", "section_id").agg(F.max("_v").alias("claimed"))
    s = sections.join(best, ["query_id", "section_id"], "left").na.fill(0.0, ["claimed"])
    s = s.withColumn("_a", min_max("score", ["query_id"])).withColumn("_b", min_max("claimed", ["query_id"]))
    s = s.withColumn("fused", F.round((own * F.col("_a") + claims * F.col("_b")) / (own + claims), 6))
    return s.withColumn("place", rank_by(["query_id"], F.desc("fused"), F.asc("rank"), F.asc("section_id"))).select("query_id", "section_id", "fused", "place")


def valid_claims(raw: DataFrame, most: int) -> DataFrame:
    """The first `most` claims (query_id, at, claim_id, claim) of each question that say something, each id and text once; missing ids become Q01, Q02, ..."""
    rows = raw.withColumn("claim", T.clip(F.col("claim"), 360)).where("claim <> ''").withColumn("_t", rank_by(["query_id", "claim"], F.asc("at"))).where("_t = 1")
    rows = rows.withColumn("place", rank_by(["query_id"], F.asc("at"))).where(F.col("place") <= most)
    named = F.coalesce(F.nullif(F.trim(T.text_of(F.col("claim_id"))), F.lit("")), F.format_string("Q%02d", F.col("place")))
    rows = rows.withColumn("claim_id", named).withColumn("_i", rank_by(["query_id", "claim_id"], F.asc("place")))
    return rows.where("_i = 1").select("query_id", "claim_id", "claim", "place")


def focused_context(records: DataFrame, questions: DataFrame, k: int = 12) -> DataFrame:
    """query_id, record_id, place: each record once, tables and words shared with the question first."""
    q = questions.select("query_id", F.array_distinct(T.tokens(F.col("question"))).alias("q"))
    rows = records.dropDuplicates(["query_id", "record_id"]).join(q, "query_id")
    rows = rows.withColumn("shared", F.size(F.array_intersect("q", F.array_distinct(T.tokens(F.col("text"))))))
    return rows.withColumn("place", rank_by(["query_id"], F.desc("shared"), F.desc(F.col("kind") == "table"), F.asc("record_id"))).where(F.col("place") <= k).select("query_id", "record_id", "place")


def remapped_rows(cells: DataFrame, schema: DataFrame, by: str) -> DataFrame:
    """by, row, values: table answers (by, row, key, value) under the schema's columns (by, name); unknown keys go, absent columns are null."""
    cells = cells.select(by, "row", "key", "value")
    named = cells.join(match_columns(cells, schema, by), [by, "key"]).groupBy(by, "row", "name").agg(F.min("value").alias("value"))
    full = cells.select(by, "row").distinct().join(schema.select(by, "name").distinct(), by)
    return full.join(named, [by, "row", "name"], "left").groupBy(by, "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))


def regular_records(items: DataFrame) -> DataFrame:
    """paper_id, page, record_id, source_type, label, text, status of parsed items (paper_id, page, at, kind, label, text).

    Kinds become official types, labels their usual form; placeholders and empty texts are rejected; ids number a page's
    items in order.
    """
    kind = F.coalesce(L.official_type(F.col("kind"), F.lit(None).cast("string")), F.lit("text_span"))
    n = rank_by(["paper_id", "page"], F.asc("at"))
    text = F.trim(F.regexp_replace(T.text_of(F.col("text")), r"\s+", " "))
    status = F.when(text == "", "empty").when(is_placeholder(text), "placeholder").otherwise("accepted")
    return items.select("paper_id", "page", F.format_string("%s::p%03d_r%04d", F.col("paper_id").cast("string"), F.col("page"), n).alias("record_id"), kind.alias("source_type"), L.label(F.col("label"), kind).alias("label"), text.alias("text"), status.alias("status"))


def counted_references(records: DataFrame, by: str) -> DataFrame:
    """by, n of bibliographies (by, number) whose numbers are exactly 1 to n; others have no row."""
    d = records.select(by, "number").distinct().groupBy(by).agg(F.count("*").alias("_n"), F.min("number").alias("_a"), F.max("number").alias("_z"))
    return d.where("_a = 1 and _z = _n").select(by, F.col("_n").alias("n"))
