"""Relations of the evidence model derived from the driver tables. The SQL strings hold in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table

#: A question about papers for every customer.
QUESTION = (
    "concat(CASE WHEN c_custkey % 3 = 0 THEN 'Compare ' WHEN c_custkey % 3 = 1 THEN 'How many of ' ELSE 'What is the highest score of ' END, "
    "'the Net', c_custkey % 9, 'X paper with \"', lower(c_mktsegment), '\" and BERT-', c_custkey % 7, ' in Table ', c_custkey % 5, "
    "CASE WHEN c_custkey % 4 = 0 THEN ', Fig. 2 and Eq. (3)' WHEN c_custkey % 4 = 1 THEN ' and the 3rd reference' ELSE '' END, "
    "CASE WHEN c_custkey % 2 = 0 THEN ' at ICML 202' ELSE ' (NeurIPS202' END, c_custkey % 6, CASE WHEN c_custkey % 2 = 0 THEN '?' ELSE ')?' END)"
)
#: A label as extraction emits them, for every part, and its source type.
LABEL = (
    "CASE p_partkey % 10 WHEN 0 THEN concat('Table ', p_size, 'a.') WHEN 1 THEN concat('Fig. ', p_size) WHEN 2 THEN concat('[', p_size, ']') "
    "WHEN 3 THEN concat('Eq. (', p_size, ')') WHEN 4 THEN concat('  Algorithm  ', p_size) WHEN 5 THEN concat('Reference 0', p_size) "
    "WHEN 6 THEN concat(p_size, '') WHEN 7 THEN 'Smith2020' WHEN 8 THEN '' ELSE p_name END"
)
KIND = "CASE p_partkey % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'citation_context' WHEN 3 THEN 'equation' WHEN 4 THEN 'reference' WHEN 5 THEN 'algorithm' ELSE 'paragraph' END"

#: CTEs for oracles.
SQL_QUESTIONS = f"questions AS (SELECT c_custkey AS query_id, {QUESTION} AS question FROM customer)"
SQL_LABELS = f"labelled AS (SELECT p_partkey AS record_id, {LABEL} AS label, {KIND} AS kind FROM part)"
SQL_PAPERS = "papers AS (SELECT doc_id AS paper_id, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract, source AS venue, lang AS year FROM documents)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, question."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.expr(QUESTION).alias("question"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, label, kind."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.expr(LABEL).alias("label"), F.expr(KIND).alias("kind"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, title (first line), abstract (the rest), venue (source), year (lang)."""
    cut = F.instr("text", "\n")
    title = F.when(cut > 0, F.expr("substr(text, 1, instr(text, '\\n') - 1)")).otherwise(F.col("text"))
    rest = F.when(cut > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), title.alias("title"), rest.alias("abstract"), F.col("source").alias("venue"), F.col("lang").alias("year"))


#: Lines of orders, each number once, with a transport.
MODE = "CASE l_suppkey % 5 WHEN 0 THEN 'AIR' WHEN 1 THEN 'REG AIR' WHEN 2 THEN 'RAIL' WHEN 3 THEN 'SHIP' ELSE 'MAIL' END"
SQL_LINES = f"lines AS (SELECT *, {MODE} AS l_mode FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_mode."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    return rows.withColumn("l_mode", F.expr(MODE))
