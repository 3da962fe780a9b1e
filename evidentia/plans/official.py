"""The whole evaluation of a set of predictions, and the checks before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as L, text as T
from ..operators import evaluation as E, selection as Y
from ..operators.scoring import coverage

LOCATOR = "struct<page:int, section:string, table_id:string, figure_id:string, equation_id:string, algorithm_id:string, citation_id:string>"
#: Questions and predictions: the same columns; a prediction's evaluation_targets are ignored, `line` orders repeats.
SCHEMA = f"query_id string, line long, evaluation_targets array<string>, papers array<string>, evidence array<struct<paper_id:string, source_type:string, locator:{LOCATOR}>>, choice string, freeform string"


def evidence_keys(rows: DataFrame) -> DataFrame:
    """query_id, key of evidence with a paper, a type and a place or an object."""
    e = rows.select("query_id", F.explode("evidence").alias("e")).select("query_id", "e.*")
    loc = lambda c: F.col(f"locator.{c}")
    key = L.evidence_key(F.col("paper_id"), F.col("source_type"), loc("page"), loc("section"), loc("table_id"), loc("figure_id"), loc("equation_id"), loc("algorithm_id"), loc("citation_id"))
    return e.select("query_id", key.alias("key")).where((F.col("key.paper_id") != "") & (F.col("key.source_type") != "") & ((F.col("key.location") != "") | (F.col("key.object_id") != "")))


def _wanted(target: str) -> Column:
    return F.col("evaluation_targets").isNull() | F.array_contains("evaluation_targets", target)


def evaluate(gold: DataFrame, pred: DataFrame) -> dict[str, DataFrame]:
    """papers and evidence (macro precision, recall, f1), answers (shares of right choices and texts), missing, extra.

    Both have SCHEMA. A question without prediction counts with an empty one; of repeated predictions the last by line
    counts. Means are null where no question is asked for that target.
    """
    own = Y.first_by(pred, ["query_id"], F.desc("line"))
    ask = lambda target: gold.where(_wanted(target))
    papers = lambda df: df.select("query_id", F.explode_outer("papers").alias("paper")).withColumn("paper", F.nullif(F.trim("paper"), F.lit("")))
    keys = ask("evidence").select("query_id").join(evidence_keys(gold), "query_id", "left")
    joined = gold.join(own.select("query_id", F.col("choice").alias("pc"), F.col("freeform").alias("pf")), "query_id", "left").where(_wanted("answer"))
    right = F.upper(F.trim(T.text_of(F.col("choice")))) == F.upper(F.trim(T.text_of(F.col("pc"))))
    same = T.normalize_answer(F.col("freeform")) == T.normalize_answer(F.col("pf"))
    answers = joined.agg(F.round(F.avg(F.when(F.col("choice").isNotNull(), right.cast("int"))), 6).alias("choice_accuracy"), F.round(F.avg(F.when(F.col("freeform").isNotNull(), same.cast("int"))), 6).alias("freeform_match"))
    return {
        "papers": E.macro(coverage(papers(ask("papers")), papers(own), "query_id", "paper")),
        "evidence": E.macro(coverage(keys, evidence_keys(own), "query_id", "key")),
        "answers": answers,
        "missing": gold.select("query_id").join(own, "query_id", "left_anti"),
        "extra": own.select("query_id").join(gold, "query_id", "left_anti"),
    }


def violations(questions: DataFrame, pred: DataFrame, papers: DataFrame | None = None) -> DataFrame:
    """key, rule of everything a set of predictions breaks: missing, unknown or repeated questions, empty or repeated papers, types and papers that are not there."""
    asked = questions.select("query_id").distinct()
    items = pred.select("query_id", F.explode("evidence").alias("e")).select("query_id", "e.*")
    cited = pred.select("query_id", F.explode("papers").alias("paper_id"))
    rules = [
        ("missing_prediction", asked.join(pred, "query_id", "left_anti"), F.col("query_id")),
        ("unknown_query", pred.join(asked, "query_id", "left_anti"), F.col("query_id")),
        ("repeated_query", pred.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1"), F.col("query_id")),
        ("no_papers", pred.where(F.coalesce(F.size("papers"), F.lit(0)) < 1), F.col("query_id")),
        ("repeated_paper", cited.groupBy("query_id", "paper_id").agg(F.count("*").alias("n")).where("n > 1"), F.concat_ws("/", "query_id", "paper_id")),
        ("bad_source_type", items.where(~F.coalesce(F.col("source_type").isin(*L.OFFICIAL_TYPES), F.lit(False))), F.col("query_id")),
        ("evidence_of_other_paper", items.join(cited, ["query_id", "paper_id"], "left_anti"), F.concat_ws("/", "query_id", "paper_id")),
    ]
    if papers is not None:
        rules.append(("unknown_paper", cited.join(papers.select("paper_id").distinct(), "paper_id", "left_anti"), F.concat_ws("/", "query_id", "paper_id")))
    return E.violations(*rules)
