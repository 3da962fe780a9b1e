"""Packets of selected packages, and prompts that fit a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import text_of


def packets(packages: DataFrame, records: DataFrame) -> DataFrame:
    """query_id, chunk_ref, package_id, paper_id, section_id, records: the records of packages by section, each record once.

    packages: query_id, place, package_id, position, record_id; records: query_id, record_id, paper_id, section_id, text. A record that
    stands in several packages belongs to the first; sections come in the order of their first record.
    """
    held = packages.join(records, ["query_id", "record_id"])
    first = held.withColumn("_i", F.row_number().over(W.partitionBy("query_id", "record_id").orderBy("place", "position"))).where("_i = 1")
    by = ["query_id", "place", "package_id", "paper_id", "section_id"]
    rows = first.groupBy(*by).agg(F.min("position").alias("_first"), F.array_sort(F.collect_list(F.struct("position", "record_id", "text"))).alias("_r"))
    number = F.row_number().over(W.partitionBy("query_id", "place", "package_id").orderBy("_first", "paper_id", "section_id")) - 1
    return rows.withColumn("_n", number).select("query_id", F.format_string("%s::s%02d", F.col("package_id").cast("string"), "_n").alias("chunk_ref"), "package_id", "paper_id", "section_id", F.transform("_r", lambda x: F.struct(x["record_id"].alias("record_id"), x["text"].alias("text"))).alias("records"))


def fitted(cards: DataFrame, micro: DataFrame, fixed: DataFrame, limit: int) -> DataFrame:
    """query_id, cards, micro, chars: how many cards and micro rows of each question fit a prompt.

    cards and micro: query_id, place, chars (what a row adds to the prompt); fixed: query_id, chars (the rest of it). As
    many cards as fit come first, in their order; micro rows take what is then left. A limit of 0 fits all.
    """
    upto = lambda df: df.withColumn("upto", F.sum("chars").over(W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)))
    room = F.lit(limit) - F.col("base")
    c = upto(cards).join(fixed.select("query_id", F.col("chars").alias("base")), "query_id").where((F.lit(limit) <= 0) | (F.col("upto") <= room))
    c = c.groupBy("query_id").agg(F.count("*").alias("cards"), F.max("upto").alias("used"))
    base = fixed.select("query_id", F.col("chars").alias("base")).join(c, "query_id", "left").na.fill(0, ["cards", "used"])
    m = upto(micro).join(base, "query_id").where((F.lit(limit) <= 0) | (F.col("upto") + F.col("used") <= room)).groupBy("query_id").agg(F.count("*").alias("micro"), F.max("upto").alias("more"))
    return base.join(m, "query_id", "left").na.fill(0, ["micro", "more"]).select("query_id", "cards", "micro", (F.col("base") + F.col("used") + F.col("more")).alias("chars"))


def messages(questions: DataFrame, candidates: DataFrame, contexts: DataFrame, rules: Column | str = "Answer from the given evidence alone, as JSON.") -> DataFrame:
    """query_id, messages: a system and a user message per question, the user's a JSON text of question, contract, candidates and evidence.

    questions: query_id, question, answer_types; candidates: query_id, rank, paper_id, title; contexts: query_id, place,
    evidence_ref, text. Lists are in order; a question without candidates or evidence has empty ones.
    """
    c = candidates.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "paper_id", "title"))), lambda x: F.struct(x["paper_id"].alias("paper_id"), x["title"].alias("title"))).alias("candidates"))
    e = contexts.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence_ref", "text"))), lambda x: F.struct(x["evidence_ref"].alias("evidence_ref"), x["text"].alias("text"))).alias("evidence"))
    rows = questions.join(c, "query_id", "left").join(e, "query_id", "left")
    empty = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    body = F.to_json(F.struct(text_of(F.col("question")).alias("question"), F.struct("answer_types").alias("contract"), empty("candidates", c.schema["candidates"].dataType), empty("evidence", e.schema["evidence"].dataType)))
    system = F.lit(rules) if isinstance(rules, str) else rules
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return rows.select("query_id", F.array(message("system", system), message("user", body)).alias("messages"))


def candidate_view(candidates: DataFrame, rank: str, *, head: int = 60, title_chars: int = 120, abstract_chars: int = 200) -> DataFrame:
    """candidates (rank, title, abstract) as a prompt shows them: titles cut, and abstracts cut for the first `head` alone."""
    abstract = F.when(F.col(rank) <= head, F.substring("abstract", 1, abstract_chars)).otherwise("")
    return candidates.withColumn("title", F.substring("title", 1, title_chars)).withColumn("abstract", abstract)
