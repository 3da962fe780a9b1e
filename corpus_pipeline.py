"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.common import materialize, read
from evidentia.llm.mixing import take_mix
from evidentia.llm.near_dedup import keep_one
from evidentia.llm.packing import pack
from evidentia.llm.quality import keep_good
from evidentia.llm.toxicity import fit, keep_harmless, training_sample


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their hosts' boilerplate lines."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half under a grammar learned from the labelled ones."""
    return keep_harmless(docs, fit(training_sample(docs, read(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights takes them."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents with their places in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The digests, learned weights and token ids of these stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents`."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
