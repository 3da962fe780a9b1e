"""Manifests of inputs, refused resumes and reuse of cached artifacts."""

import hashlib

import pytest

from evidentia.sources import provenance as V


@pytest.fixture
def inputs(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"a": 1}\n')
    spark.range(50).repartition(3).write.parquet(f"{tmp_path}/contexts")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.json").write_text("{}")
    return {"questions": f"{tmp_path}/q.jsonl", "contexts": f"file://{tmp_path}/contexts", "deep": f"{tmp_path}/deep", "none": None}


def test_manifest_names_and_digests_its_inputs(spark, inputs):
    got = V.build_manifest(spark, inputs, {"mode": "x", "limit": 3})
    assert got["inference_inputs_only"] and set(got["sources"]) == {"questions", "contexts", "deep"} and got["parameters"] == {"mode": "x", "limit": 3}
    assert got["sources"]["contexts"]["files"] == 3
    files = {(r["source"], r["name"]): r for r in V.file_digests(spark, {k: p for k, p in inputs.items() if p}).collect()}
    assert files["deep", "er/x.json"]["sha256"] == hashlib.sha256(b"{}").hexdigest()
    assert files["questions", "q.jsonl"]["bytes"] == 9
    leaf = f"er/x.json 2 {hashlib.sha256(b'{}').hexdigest()}"
    part = hashlib.sha256(b"er/x.json").hexdigest()[:2]
    assert got["sources"]["deep"]["sha256"] == hashlib.sha256(f"{part} {hashlib.sha256(leaf.encode()).hexdigest()}".encode()).hexdigest()
    assert V.build_manifest(spark, inputs, {"mode": "x", "limit": 3}) == got


def test_one_changed_byte_refuses_a_resume(spark, inputs, tmp_path):
    out = f"{tmp_path}/out"
    first = V.build_manifest(spark, inputs, {"mode": "x"})
    V.write_or_validate(spark, out, first, resume=True)
    V.write_or_validate(spark, out, first, resume=True)
    assert V.read_manifest(spark, out) == first
    (tmp_path / "deep" / "er" / "x.json").write_text("[]")
    other = V.build_manifest(spark, inputs, {"mode": "x"})
    with pytest.raises(ValueError, match="source deep"):
        V.write_or_validate(spark, out, other, resume=True)
    with pytest.raises(ValueError, match="parameter mode"):
        V.write_or_validate(spark, out, {**first, "parameters": {"mode": "y"}}, resume=True)
    assert V.read_manifest(spark, out) == first
    V.write_or_validate(spark, out, other, resume=False)
    assert V.read_manifest(spark, out) == other


def test_a_renamed_or_moved_file_is_another_input(spark, tmp_path):
    digest = lambda: V.build_manifest(spark, {"d": f"{tmp_path}/d"}, {})["sources"]["d"]["sha256"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_text("1")
    (tmp_path / "d" / "b").write_text("2")
    before = digest()
    (tmp_path / "d" / "a").rename(tmp_path / "d" / "c")
    assert digest() != before


@pytest.mark.parametrize("where", ["validation.jsonl", "folder"])
def test_gold_is_refused(spark, tmp_path, where):
    (tmp_path / "folder").mkdir()
    for p in (tmp_path / "validation.jsonl", tmp_path / "folder" / "validation.jsonl"):
        p.write_text("{}")
    with pytest.raises(ValueError, match="gold labels"):
        V.build_manifest(spark, {"inputs": f"{tmp_path}/{where}"}, {})


def test_only_complete_artifacts_of_the_same_versions_are_used_again(spark):
    wanted = spark.createDataFrame([(p, "m", 144, "v2") for p in ("ok", "old", "part", "empty", "none", "two", "untold")] + [(None, "m", 144, "v2"), ("nulls", None, 144, "v2")], "paper string, model string, dpi int, version string")
    cached = spark.createDataFrame([("ok", "m", 144, "v2", "complete", 9), ("old", "m", 144, "v1", "complete", 9), ("part", "m", 144, "v2", "partial", 9), ("empty", "m", 144, "v2", "complete", 0), ("two", "x", 144, "v2", "complete", 9), ("two", "m", 144, "v2", "complete", 9), ("two", "m", 144, "v2", "complete", 9), ("untold", "m", None, "v2", "complete", 9), ("nulls", None, 144, "v2", "complete", 9)], "paper string, model string, dpi int, version string, status string, bytes long")
    own = lambda **how: {r["paper"] for r in V.reusable(wanted, cached, ["model", "dpi", "version"], keys=["paper"], **how).collect() if r["reuse"]}
    assert own() == {"ok", "two"} and own(partial=True) == {"ok", "two", "part"} and own(lenient=("dpi",)) == {"ok", "two", "untold"}
    assert V.reusable(wanted, cached, ["model", "dpi", "version"], keys=["paper"]).count() == wanted.count()


def test_report_counts_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n\n{}\n")
    spark.range(4).write.parquet(f"{tmp_path}/p")
    assert {r["name"]: r["value"] for r in V.report(spark, {"seconds": 2}, {"a": f"{tmp_path}/a.jsonl", "p": f"{tmp_path}/p"}).collect()} == {"a_rows": "2", "p_rows": "4", "seconds": "2"}
