"""Predictions made regular: papers from the candidates, evidence from what was selected, answers that their evidence supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import labels as L, text as T
from ..session import staged
from .grounding import fact_supported, flat
from .hierarchy import allowed_locators, resolve_claims
from .scoring import rank_by

# Fields that stay inside, and the parts of an evidence score.
INTERNAL = (
    "confidence", "notes", "global_record_id", "record_type", "bbox_1000", "bbox_pixel", "validation_status", "record_id", "label",
    "image_ref", "vlm_parse_confidence", "contributing_papers", "table_answer_plan",
)
PREFERRED, PREFERRED_HINT, SAME_TYPE, TYPE_HINT, SAME_PAGE, SAME_PAPER, PER_PLACE = 1.2, 0.9, 1.0, 0.8, 0.7, 0.5, 0.001
EXPLICIT_CLAIM = r"(?i)\b(?:explicitly\s+(?:mention|reference)|explicit\s+(?:mention|reference)|labeled?|named)\b"
CLAIM_TERM = r"\b[A-Z][A-Z0-9-]{1,}\b"


def _public(value: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        kept = [f for f in kind.fields if f.name not in INTERNAL]
        return F.when(value.isNotNull(), F.struct(*[_public(value[f.name], f.dataType).alias(f.name) for f in kept])) if kept else F.lit(None)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(value, lambda x: _public(x, kind.elementType))
    return value


def public(df: DataFrame) -> DataFrame:
    """df without internal fields, at any depth of its structs and arrays."""
    return df.select(*[_public(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in INTERNAL])


def candidate_papers(predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, paper_id, place, audit: predicted papers (query_id, at, paper_id), each once, from candidates (query_id, rank, paper_id).

    A paper that is no candidate becomes the first one, which stands in for a question without any. audit: empty,
    noncandidate_paper_id or fallback_paper_id.
    """
    top = candidates.groupBy("query_id").agg(F.min_by("paper_id", "rank").alias("top"))
    known = candidates.select("query_id", "paper_id", F.lit(True).alias("_known")).distinct()
    rows = predicted.where(T.text_of(F.col("paper_id")) != "").join(known, ["query_id", "paper_id"], "left").join(top, "query_id", "left")
    rows = rows.withColumn("audit", F.when(F.col("_known"), "").otherwise("noncandidate_paper_id")).withColumn("paper_id", F.when(F.col("_known"), F.col("paper_id")).otherwise(F.col("top"))).where("paper_id is not null")
    once = rows.withColumn("_i", rank_by(["query_id", "paper_id"], F.asc("at"))).where("_i = 1").select("query_id", "paper_id", "at", "audit")
    none = top.join(once.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.col("top").alias("paper_id"), F.lit(0).cast("long").alias("at"), F.lit("fallback_paper_id").alias("audit"))
    both = once.withColumn("at", F.col("at").cast("long")).unionByName(none)
    return both.withColumn("place", rank_by(["query_id"], F.asc("at"), F.asc("paper_id"))).select("query_id", "paper_id", "place", "audit")


def echoed_evidence(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, evidence_ref, paper_id, source_type, page, label, known of echoed refs (query_id, at, evidence_ref), each once, in order (place); unknown ones have no record."""
    once = refs.where(T.text_of(F.col("evidence_ref")) != "").groupBy("query_id", "evidence_ref").agg(F.min("at").alias("at"))
    held = catalog.select("query_id", "evidence_ref", "paper_id", "source_type", "page", "label", F.lit(True).alias("known"))
    rows = once.join(held, ["query_id", "evidence_ref"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.withColumn("place", rank_by(["query_id"], F.asc("at"), F.asc("evidence_ref"))).drop("at")


def best_evidence(items: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, at, place, score: for each item the selected record that fits it best.

    items: query_id, at, paper_id, source_type, page (null: unknown), text (question, answer and item), papers and
    preferred (arrays); selected: query_id, place, paper_id, source_type, page, text, hints (array of struct source_type,
    page, label). An item's paper, or else the predicted papers, limit the records; without any of those, it has none.
    """
    s = selected.select("query_id", "place", *[F.col(c).alias(f"_{c}") for c in ("paper_id", "source_type", "page", "text")], F.transform("hints", lambda h: h["source_type"]).alias("_hints"))
    own = T.text_of(F.col("paper_id"))
    rows = items.join(s, "query_id").where(F.when(own != "", F.col("_paper_id") == F.col("paper_id")).when(F.size("papers") > 0, F.array_contains("papers", F.col("_paper_id"))).otherwise(True))
    rows = rows.withColumn("_i", rank_by(["query_id", "at"], F.asc("place")) - 1)
    bonus = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    kind = T.text_of(F.col("source_type"))
    score = (
        T.overlap_coefficient(F.col("text"), F.col("_text"))
        + bonus(F.array_contains("preferred", F.col("_source_type")), PREFERRED)
        + bonus(F.arrays_overlap("preferred", "_hints"), PREFERRED_HINT)
        + bonus((kind != "") & (F.col("_source_type") == kind), SAME_TYPE)
        + bonus((kind != "") & F.array_contains("_hints", kind), TYPE_HINT)
        + bonus(F.col("page") == F.col("_page"), SAME_PAGE)
        + bonus((own != "") & (F.col("_paper_id") == own), SAME_PAPER)
        - F.col("_i") * PER_PLACE
    )
    best = rows.withColumn("score", F.round(score, 6)).withColumn("_b", rank_by(["query_id", "at"], F.desc("score"), F.asc("place")))
    return best.where("_b = 1").select("query_id", "at", "place", "score")


def standard_evidence(items: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, paper_id, source_type, page, label, place, audit: predicted evidence put on records that were selected.

    items: as for best_evidence, with label. What the selected records allow stays; anything else becomes the best record under its
    own limits, or else the best of all, with the locator of the hint for the item's type or the first preferred type
    that it has a hint for, or its own. Questions whose items leave nothing get the best of all. Locators stand once.
    """
    records = selected.select("query_id", "place", "paper_id", "source_type", "page", "label", "hints")
    kinds = records.select("query_id", "paper_id", F.col("source_type").alias("kind"), "page", "label").unionByName(
        records.select("query_id", "paper_id", F.explode("hints").alias("h")).select("query_id", "paper_id", F.col("h.source_type").alias("kind"), F.col("h.page").alias("page"), F.col("h.label").alias("label"))
    )
    allowed = allowed_locators(kinds)
    rows = items.withColumn("kind", F.col("source_type")).join(allowed, ["query_id", "paper_id", "kind"], "left")
    labelled = T.text_of(F.col("label")) != ""
    fits = F.coalesce(F.array_contains("pages", F.col("page")) & (~labelled | F.array_contains("labels", L.label(F.col("label"), F.col("kind")))), F.lit(False))
    rows = staged(rows.withColumn("fits", fits), "fits")
    kept = rows.where("fits").select("query_id", "at", "paper_id", F.col("kind").alias("source_type"), "page", F.when(labelled, F.col("label")).alias("label"), F.lit("").alias("audit"))
    other = rows.where(~F.col("fits")).drop("kind", "pages", "labels", "fits")
    free = lambda df: df.withColumn("paper_id", F.lit(None).cast(items.schema["paper_id"].dataType)).withColumn("source_type", F.lit(None).cast("string")).withColumn("page", F.lit(None).cast(items.schema["page"].dataType)).withColumn("papers", F.array().cast(items.schema["papers"].dataType))

    def placed(asked: DataFrame, audit: str) -> DataFrame:
        near = staged(best_evidence(asked, selected), "near")
        rest = asked.join(near.select("query_id", "at"), ["query_id", "at"], "left_anti")
        near = near.unionByName(best_evidence(free(rest), selected)).select("query_id", "at", "place")
        found = asked.select("query_id", "at", F.col("source_type").alias("_raw"), "preferred").join(near, ["query_id", "at"]).join(records, ["query_id", "place"])
        has = F.transform("hints", lambda h: h["source_type"])
        wanted = F.coalesce(F.when(F.array_contains(has, F.col("_raw")), F.col("_raw")), F.get(F.filter("preferred", lambda p: F.array_contains(has, p)), F.lit(0)), F.col("source_type"))
        found = found.withColumn("_kind", wanted).withColumn("_hint", F.get(F.filter("hints", lambda h: h["source_type"] == F.col("_kind")), F.lit(0)))
        page, name = F.coalesce(F.col("_hint.page"), F.col("page")), F.when(F.col("_hint").isNotNull(), F.col("_hint.label")).otherwise(F.col("label"))
        return found.select("query_id", "at", "paper_id", F.col("_kind").alias("source_type"), page.alias("page"), F.nullif(name, F.lit("")).alias("label"), F.lit(audit).alias("audit")).where("page > 0")

    moved = staged(kept.unionByName(placed(other, "symbolic_evidence_locator_standardized")), "moved")
    asked = selected.select("query_id").distinct().join(moved.select("query_id").distinct(), "query_id", "left_anti")
    context = items.groupBy("query_id").agg(F.min_by("text", "at").alias("text"), F.first("papers").alias("papers"), F.first("preferred").alias("preferred"), F.min("at").alias("at"))
    empty = free(context.join(asked, "query_id").withColumn("label", F.lit(None).cast("string"))).withColumn("papers", F.col("papers"))
    every = moved.unionByName(placed(empty.select(*[c for c in items.columns]), "symbolic_evidence_empty_filled"))
    once = every.withColumn("_i", rank_by(["query_id", "paper_id", "source_type", "page", "label"], F.asc("at"))).where("_i = 1")
    return once.withColumn("place", rank_by(["query_id"], F.asc("at"))).select("query_id", "paper_id", "source_type", "page", "label", "place", "audit")


def fact_gate(values: DataFrame, evidence: DataFrame, verified: DataFrame) -> DataFrame:
    """query_id, field, value, status: answer values (query_id, field, value) that their evidence supports; others become empty.

    evidence: query_id, text (all that the answer cites, seen texts of images too); verified: query_id, value, how
    (visual, derived or slot: values that an extraction has checked already).
    """
    text = evidence.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(T.text_of(F.col("text")))), "\n").alias("_text"))
    held = verified.select("query_id", flat(F.col("value")).alias("_v"), "how").where("_v <> ''").groupBy("query_id", "_v").agg(F.min_by("how", F.when(F.col("how") == "visual", 0).when(F.col("how") == "derived", 1).otherwise(2)).alias("how"))
    rows = values.where(F.trim(T.text_of(F.col("value"))) != "").withColumn("_v", flat(F.col("value"))).join(text, "query_id", "left").join(held, ["query_id", "_v"], "left")
    names = F.when(F.col("how") == "visual", "visual_slot_grounded").when(F.col("how") == "derived", "derived_value_grounded").when(F.col("how") == "slot", "slot_supported_grounded")
    direct = fact_supported(F.col("value"), F.col("_text"))
    status = F.coalesce(names, F.when(direct, "directly_grounded").otherwise("unsupported_value_removed"))
    return rows.select("query_id", "field", F.when(status == "unsupported_value_removed", "").otherwise(F.col("value")).alias("value"), status.alias("status"))


def grounded_claims(claims: DataFrame, cards: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, claim_id, card_key, evidence_ref, paper_id, status of claims (query_id, claim_id, claim, keys, primary).

    cards: query_id, card_key, evidence_ref, source_type, proposition. Unknown keys are unresolved. Where a claim wants
    an explicit mention, a card of the primary type must hold one of the claim's capitalised terms.
    """
    terms = F.transform(F.filter(F.array_distinct(F.regexp_extract_all(T.text_of(F.col("claim")), F.lit(CLAIM_TERM), 0)), lambda t: ~t.isin("PDF", "QA")), lambda t: F.lower(t))
    text = claims.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(T.text_of(F.col("claim")))), " ").alias("claim"), F.first("primary").alias("primary"))
    text = text.select("query_id", "primary", F.col("claim").rlike(EXPLICIT_CLAIM).alias("explicit"), terms.alias("terms"))
    rows = resolve_claims(claims, cards, catalog).join(cards.select("query_id", "card_key", "source_type", F.lower("proposition").alias("_p")), ["query_id", "card_key"], "left").join(text, "query_id")
    bound = F.col("explicit") & (F.size("terms") > 0) & F.coalesce(F.col("source_type") == F.col("primary"), F.lit(False))
    fits = ~bound | F.exists("terms", lambda t: F.contains(F.col("_p"), t))
    status = F.when(F.col("evidence_ref").isNull(), "unknown_card_key").when(fits, "grounded").otherwise("claim_key_constraint_removed")
    return rows.select("query_id", "claim_id", "card_key", "evidence_ref", "paper_id", status.alias("status"))


def grounded_rows(plan: DataFrame, claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, row, evidence_ref, status of planned table rows (query_id, row, card_key, column, value).

    A row needs a card that a claim was grounded by (claims: as grounded_claims gives them), and its record must support
    all its values; a paper's title may be the record's paper_id instead. Rows without values go.
    """
    linked = claims.where("status = 'grounded'").groupBy("query_id", "card_key").agg(F.min("evidence_ref").alias("evidence_ref"))
    rows = plan.join(linked, ["query_id", "card_key"], "left").join(catalog.select("query_id", "evidence_ref", "paper_id", "text"), ["query_id", "evidence_ref"], "left")
    filled = F.trim(T.text_of(F.col("value"))) != ""
    title = (F.lower(F.trim("column")) == "paper title") & (F.trim(T.text_of(F.col("value"))) == F.col("paper_id").cast("string"))
    good = ~filled | title | fact_supported(F.col("value"), F.col("text"))
    per = rows.groupBy("query_id", "row", "evidence_ref").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good"), F.bool_or(filled).alias("filled"))
    status = F.when(F.col("evidence_ref").isNull(), "table_plan_unlinked_to_claim_removed").when(F.col("good") & F.col("filled"), "table_plan_grounded").otherwise("unsupported_table_row_removed")
    return per.select("query_id", "row", "evidence_ref", status.alias("status"))


def grounded_predictions(papers: DataFrame, claims: DataFrame, rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, evidence_refs, papers, rows: what is left of a prediction once its claims and table rows are grounded.

    papers: query_id, paper_id as predicted; claims and rows as grounded_claims and grounded_rows give them. Refs are
    those of grounded claims and accepted rows; papers that no such ref supports go.
    """
    rows = staged(rows.where("status = 'table_plan_grounded'"), "rows")
    refs = claims.where("status = 'grounded'").select("query_id", "evidence_ref").unionByName(rows.where("status = 'table_plan_grounded'").select("query_id", "evidence_ref")).distinct()
    held = refs.join(catalog.select("query_id", "evidence_ref", "paper_id"), ["query_id", "evidence_ref"]).select("query_id", "paper_id").distinct()
    a = refs.groupBy("query_id").agg(F.array_sort(F.collect_list("evidence_ref")).alias("evidence_refs"))
    b = papers.join(held, ["query_id", "paper_id"]).groupBy("query_id").agg(F.array_sort(F.collect_set("paper_id")).alias("papers"))
    c = rows.where("status = 'table_plan_grounded'").groupBy("query_id").agg(F.count("*").alias("rows"))
    return papers.select("query_id").distinct().join(a, "query_id", "left").join(b, "query_id", "left").join(c, "query_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def table_rows(cells: DataFrame, questions: DataFrame, schema: DataFrame) -> DataFrame:
    """query_id, row, column, value, number, audit: answer tables cleaned.

    cells: query_id, row, column, value; schema: query_id, column, place, kind (string, number or boolean; the first column is
    the row key); questions: query_id, aliases (array of names the question gives its rows). Cells under no column of
    the schema, empty rows, rows without a key and repeated keys go; a key that matches one alias alone becomes it;
    numbers lose separators and units, plus-minus signs their spaces.
    """
    kept = cells.join(schema, ["query_id", "column"]).where(F.trim(T.text_of(F.col("value"))) != "")
    key = kept.groupBy("query_id", "row").agg(F.max(F.when(F.col("place") == 0, F.col("value"))).alias("key"))
    key = key.join(questions.select("query_id", "aliases"), "query_id", "left")
    own = T.compact(F.col("key"))
    match = F.filter("aliases", lambda a: (T.compact(a) != "") & own.contains(T.compact(a)))
    key = key.withColumn("named", F.when(F.size(match) == 1, F.get(match, F.lit(0))).otherwise(F.col("key")))
    key = key.withColumn("audit", F.when(F.coalesce(own, F.lit("")) == "", "table_row_without_row_key_removed").when(F.col("named") != F.col("key"), "table_question_alias_row_key_canonicalized").otherwise(""))
    key = key.withColumn("_i", F.row_number().over(W.partitionBy("query_id", T.compact(F.col("named"))).orderBy("row")))
    key = key.where("audit <> 'table_row_without_row_key_removed' and _i = 1").select("query_id", "row", "named", "audit")
    rows = kept.join(key, ["query_id", "row"])
    value = F.regexp_replace(F.when(F.col("place") == 0, F.col("named")).otherwise(F.col("value")), r"\s*±\s*", "±")
    return rows.select("query_id", "row", "column", value.alias("value"), F.when(F.col("kind") == "number", T.coerce_number(value)).alias("number"), "audit")
