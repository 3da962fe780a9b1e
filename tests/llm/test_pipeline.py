"""The corpus pipeline against plain Python, stage by stage, and the queries against their oracles."""

import collections
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op1_chat", "op2_quality", "op7_warc"])
def test_oracle(spark, name):
    import __spark_entry__ as entry

    from tests.oracle import compare

    compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)


def test_stages(spark):
    import corpus_pipeline as p
    from evidentia.llm.common import materialize
    from evidentia.llm.mixing import source_targets
    from tests.llm.test_ops import brute_classes, quality_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    raw = docs.collect()
    good = materialize(p.quality_rules(spark, docs, SF), "t")
    assert good.columns == columns
    want = {r[0] for r in quality_by_hand([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in raw]) if r[7]}
    assert {r["doc_id"] for r in good.collect()} == want
    mild = materialize(p.toxicity(spark, good, SF), "t")
    assert mild.columns == columns and {r["doc_id"] for r in mild.collect()} <= want
    kept = materialize(p.near_dedup(spark, mild, SF), "t")
    rows = mild.orderBy("doc_id").collect()
    roots = brute_classes([r["text"] for r in rows])
    first = {min(r["doc_id"] for r, c in zip(rows, roots, strict=True) if c == k) for k in set(roots)}
    assert kept.columns == columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(first)
    mixed = materialize(p.mixing(spark, kept, SF), "t")
    quotas = {r["source"]: r["target"] for r in source_targets(kept).collect()}
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    longest = max(len(WORD.findall(r["text"])) for r in kept.collect())
    assert mixed.columns == columns and all(abs(taken[s] - q) <= longest for s, q in quotas.items())
    packed = p.packing(spark, mixed, SF)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed.collect()}
    assert packed.groupBy().sum("length").first()[0] == sum(tokens[r["doc_id"]] for r in mixed.collect())


def test_run_gives_the_last_stage(spark):
    import corpus_pipeline as p

    assert p.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 4 <= len(p.STAGES) <= 5
