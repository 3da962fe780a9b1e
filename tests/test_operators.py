"""Hand-worked cases of the library's operators."""

import collections
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.functions import json_tools as J, labels as L, text as T
from evidentia.operators import coverage as C, evaluation as E, fuzzy, scoring as S, sections as X, selection as Y
from evidentia.plans.evidence import EvidenceOptions, evidence, records_of, routed, units
from evidentia.sources import jsonl, providers
from evidentia.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("gold", "pred", "want"), [([], [], (1, 1, 1)), (["a"], [], (0, 0, 0)), ([], ["a"], (0, 1, 0)), (["a", "b", "c"], ["b", "c", "d", "e"], (1 / 2, 2 / 3, 4 / 7))])
def test_set_metrics(spark, gold, pred, want):
    g = spark.createDataFrame([("q", x) for x in gold] + [("q", None)], "q string, x string")
    p = spark.createDataFrame([("q", x) for x in pred] + [("other", "z")], "q string, x string")
    r = S.coverage(g, p, "q", "x").first()
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(want)


@pytest.mark.parametrize(("gold", "pred", "kind", "want"), [("12.5%", "12.5", "number", True), ("1,000", "1000", "number", False), ("a", "false", "boolean", True), ("", "false", "boolean", False), (None, None, "string", True), (None, "", "string", False), (" 'Ab  c' ", "ab c", "string", True)])
def test_cells(spark, gold, pred, kind, want):
    assert value(spark, L.cell_equal(lit(gold).cast("string"), lit(pred).cast("string"), lit(kind))) is want


@pytest.mark.parametrize(("text", "want"), [("7", "table 7"), ("Table 7", "table 7"), ("TABLE 7a", "table 7a"), ("", ""), ("Appendix", "appendix")])
def test_visible_ids(spark, text, want):
    assert value(spark, L.visible_id(lit(text), "table")) == want


@pytest.mark.parametrize(("text", "want"), [("Reference 07", "7"), ("[12]", "12"), ("Smith2020", "Smith2020"), (None, "")])
def test_citation_ids(spark, text, want):
    assert value(spark, L.citation_id(lit(text).cast("string"))) == want


def test_evidence_key_without_page(spark):
    none = lit(None).cast("string")
    key = value(spark, L.evidence_key(lit("p"), lit("text_span"), lit(0), lit("Results"), none, none, none, none, none))
    assert tuple(key) == ("p", "text_span", "Results", "")
    key = value(spark, L.evidence_key(lit("p"), lit("equation_algorithm"), lit(3), none, none, none, none, lit("3"), none))
    assert tuple(key) == ("p", "equation_algorithm", "3", "equation 3")


def test_question_functions(spark):
    q = lit("Which NeurIPS papers compare 'Foo Bar' and ResNet-50 at ICML 2021, see Figure 3 and Eq. (2)?")
    assert value(spark, T.query_mentions(q)) == ["NeurIPS", "ResNet-50", "ICML", "Foo Bar"]
    assert value(spark, T.venue_hints(q)) == ["ICML", "NeurIPS"]
    assert value(spark, T.adjacent_venue_years(q)) == ["ICML|2021"]
    assert value(spark, L.numbered_types(q)) == ["figure", "equation_algorithm"]
    assert value(spark, L.is_multi_paper(q)) is True
    assert value(spark, T.acronym(T.title_words(lit("The Art of Deep Models")))) == "adm"
    assert value(spark, T.decimal_text(lit(12.5))) == "12.5" and value(spark, T.decimal_text(lit(12.0))) == "12"
    assert value(spark, T.clip(lit("a  b c"), 4)) == "a b…"


def test_scores(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", None), ("b", 0.2), ("b", 0.6), ("b", 1.0), ("c", 0.0), ("c", 1.0)], "k string, v double")
    assert [r["x"] for r in rows.where("k = 'a'").select(S.min_max("v", ["k"]).alias("x")).collect()] == [0.5, 0.5, None]
    p = {r["k"]: r for r in S.pooled(rows.where("v is not null"), ["k"], "v", sharpness=2.0, k=2).collect()}
    assert p["c"]["lme"] == pytest.approx(0.716890, abs=1e-6) and p["b"]["top_mean"] == pytest.approx(0.8)
    r = spark.createDataFrame([(1, 3)], "a int, b int").select(S.reciprocal_rank("a", "b").alias("x")).first()["x"]
    assert r == pytest.approx(1 / 61 + 1 / 63)
    values = [("a", float(k * k % 101)) for k in range(500)] + [("b", 7.0)] * 50 + [("b", None), ("c", -1.0), ("c", 3.0), ("d", None)]
    got = {r["k"]: (r["p90"], r["p50"]) for r in S.nearest_ranks(spark.createDataFrame(values, "k string, v double"), "k", "v", {"p90": 0.9, "p50": 0.5}, buckets=16).collect()}
    own = sorted(v for k, v in values if k == "a")
    assert got == {"a": (own[449], own[249]), "b": (7.0, 7.0), "c": (3.0, -1.0)}


def test_budgets(spark):
    rows = spark.createDataFrame([("q", k, n) for k, n in enumerate([50, 30, 40, 5])], "q string, k long, n long")
    kept = Y.char_prefix(rows, ["q"], "n", 85, F.asc("k")).orderBy("k").collect()
    assert [r["k"] for r in kept] == [0, 1] and all(r["truncated"] for r in kept)
    rows = spark.createDataFrame([("q", k, n) for k, n in enumerate([50, 40, 30])], "q string, k long, n long")
    assert sorted(r["k"] for r in Y.skip_budget(rows, "q", "k", "n", 85, "k").collect()) == [0, 2]


def _covered(sets, budget):
    return max((len(set().union(*c)) for n in range(budget + 1) for c in itertools.combinations(sets, n)), default=0)


def test_coverage_sets(spark):
    rows = spark.createDataFrame([("q", 1, [0, 1]), ("q", 2, [0]), ("q", 3, [2]), ("q", 4, [0, 1]), ("r", 1, [])], "q string, m long, items array<long>")
    assert sorted((r["m"], r["items"]) for r in C.undominated(rows, "q", "m").collect()) == [(1, [0, 1]), (3, [2])]
    got = {r["q"]: r for r in C.max_coverage(rows, "q", "m", 2).collect()}
    assert (got["q"]["covered"], got["q"]["members"]) == (3, [1, 3]) and (got["r"]["covered"], got["r"]["members"]) == (0, [])
    hits = spark.createDataFrame([("q", 1, 5), ("q", 1, 5), ("q", 1, 3), ("q", 2, None)], "q string, m long, x long")
    assert sorted((r["m"], r["items"]) for r in C.coverage_sets(hits, "q", "m", "x").collect()) == [(1, [3, 5]), (2, [])]


@pytest.mark.parametrize("items", [70, 500])
def test_coverage_of_many_items(spark, items):
    """Beyond the bits of a long: members {0, 63} and {1} cover three items; random sets against brute force."""
    rng = random.Random(items)
    few = [[0, 63], [1]]
    some = [sorted(rng.sample(range(items), rng.randint(1, items // 3))) for _ in range(14)]
    rows = spark.createDataFrame([(q, k, own) for q, sets in (("a", few), ("b", some)) for k, own in enumerate(sets)], "q string, m long, items array<long>")
    for budget in (2, 3):
        got = {r["q"]: r for r in C.max_coverage(rows, "q", "m", budget).collect()}
        assert got["a"]["covered"] == 3 and got["b"]["covered"] == _covered(some, budget)
        assert len(got["b"]["members"]) <= budget and len(set().union(*(some[m] for m in got["b"]["members"]))) == got["b"]["covered"]
    kept = {r["m"] for r in C.undominated(rows.where("q = 'b'"), "q", "m").collect()}
    assert kept == {k for k, own in enumerate(some) if not any(set(own) < set(o) or own == o and j < k for j, o in enumerate(some))}


def test_greedy_coverage_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(q, m, rng.choice([None, 1, 2]), sorted(rng.sample(range(80), rng.randint(0, 30))), rng.choice([None, 0.1, 0.5])) for q in "abc" for m in range(12)]
    got = {r["q"]: r["covered"] for r in C.greedy_coverage(spark.createDataFrame(rows, "q string, m long, page long, items array<long>, s double"), "q", "m", 4, 1, "s").collect()}
    for q in "abc":
        own = [r for r in rows if r[0] == q and r[3]]
        own = [r for r in own if not any(set(r[3]) < set(o[3]) or r[3] == o[3] and o[1] < r[1] for o in own)]
        seen, pages = set(), collections.Counter()
        for _ in range(4):
            open_ = [r for r in own if pages[r[2]] < 1 and set(r[3]) - seen]
            if not open_:
                break
            best = max(open_, key=lambda r: (len(set(r[3]) - seen), len(r[3]), -1.0 if r[4] is None else r[4], -r[1]))
            own.remove(best)
            seen |= set(best[3])
            pages[best[2]] += 1
        assert got[q] == len(seen)


def test_quota_evicts(spark):
    rows = spark.createDataFrame([("q", k, k in (4, 8, 9)) for k in range(1, 11)], "q string, rank long, own boolean")
    assert sorted(r["rank"] for r in Y.top1_quota(rows, ["q"], "own", 2, 6).collect()) == [1, 2, 3, 4, 5, 8]


def test_greedy_packages_do_not_depend_on_order(spark):
    rows = spark.createDataFrame([("q", k, k % 5, k % 3, ["t", "f", "x"][k % 3], (k * 7 % 11) / 11, 100 + k) for k in range(40)], "q string, package_id long, paper_id long, page long, kind string, score double, size long")
    one = sorted(map(tuple, Y.greedy_packages(rows, "q", most=8).collect()))
    assert one == sorted(map(tuple, Y.greedy_packages(rows.orderBy(F.rand(3)), "q", most=8).collect())) and 4 <= len(one) <= 8


def test_sections_and_references(spark):
    rows = spark.createDataFrame([("p", k, t, kind) for k, (t, kind) in enumerate([("front", "p"), ("Method", "heading"), ("x", "p"), ("Results", "heading"), ("y", "p")])], "p string, at long, text string, kind string")
    got = X.sections(rows, "p", "at", F.col("kind") == "heading", F.col("text")).orderBy("at").collect()
    assert [r["section_title"] for r in got] == ["front matter", "Method", "Method", "Results", "Results"]
    lines = [("References", "heading"), ("[5] A. Author, a first paper", "paragraph"), ("continued in lower case here", "paragraph"), ("B. Writer, the second paper", "paragraph"), ("tiny", "paragraph"), ("9. C. Third with a number", "paragraph"), ("Appendix", "heading"), ("D. Not a reference entry", "paragraph")]
    rows = spark.createDataFrame([("p", k, t, kind) for k, (t, kind) in enumerate(lines)], "p string, at long, text string, kind string")
    got = {r["number"]: r["text"] for r in X.references(rows, "p", "at").collect()}
    assert got == {5: "[5] A. Author, a first paper continued in lower case here", 6: "B. Writer, the second paper", 9: "9. C. Third with a number"}


def test_unit_packing(spark):
    rows = spark.createDataFrame([("p", k, k, " ".join(["w"] * n)) for k, n in enumerate([30, 40, 50, 300, 20])], "p string, at long, record_id long, text string")
    got = X.pack_units(rows, "p", "at", target=60, most=90).orderBy("unit").collect()
    assert all(r["n_tokens"] <= 90 or len(r["ids"]) > 1 for r in got)
    assert {i for r in got for i in r["ids"]} == {0, 1, 2, 3, 4} and sum(r["n_tokens"] for r in got if r["ids"] == [3]) == 300


def test_failure_ladder(spark):
    flags = {"candidate": True, "available": True, "page": True, "typed": False, "located": True, "chosen": True}
    assert value(spark, E.failure_stage({k: lit(v) for k, v in flags.items()})) == "source_type_not_extracted"


def test_json_tools():
    assert J.balanced_object('so: ```json\n{"a": {"b": "}"}} tail {') == '{"a": {"b": "}"}}'
    assert J.balanced_object("{bad} {\"a\": 1}") == '{"a": 1}' and J.balanced_object("none") is None and J.balanced_object(None) is None
    assert J.repaired_object('{"a": [1, 2') == '{"a": [1, 2]}' and J.repaired_object('{"a": "open') is None
    assert J.title_key("Caf&eacute; — Über 2!") == "cafe uber 2"


def test_title_join(spark):
    left = spark.createDataFrame([(1, "A study of very deep networks for images"), (2, "Something else entirely about four words")], "l long, title string")
    right = spark.createDataFrame([(10, "A Study of Very Deep Networks for Images."), (11, "On graphs and their many colours")], "r long, title string")
    assert [(r["l"], r["r"]) for r in fuzzy.title_join(left, right, left_key="l", right_key="r").collect()] == [(1, 10)]


def test_title_join_against_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    words = ["deep", "learning", "models", "language", "networks", "for", "with", "large", "of", "the", "analysis", "graphs"]
    right = [(k, " ".join(rng.sample(words, rng.randint(4, 9))) + (f" rareword{k}" if k % 2 else "")) for k in range(60)]

    def typo(t):
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "q", t[i] + "z"]) + t[i + 1 :]
        return t

    right += [(2000 + k, f"these common words {k}") for k in range(1001)] + [(5000, "these common words title")]  # three words that more than 1,000 titles hold
    left = [(k, typo(right[k][1])) for k in range(40)] + [(100, "these common words titel"), (101, "these common wordz titlee")]
    got = {(r["l"], r["r"], r["score"]) for r in fuzzy.title_join(spark.createDataFrame(left, "l long, title string"), spark.createDataFrame(right, "r long, title string"), left_key="l", right_key="r").collect()}
    plain = lambda rows: [(k, " ".join(t.split())) for k, t in rows]
    want = set()
    for k, x in plain(left):
        scores = []
        for r, y in plain(right):
            a, b = set(x.split()), set(y.split())
            if min(len(a), len(b)) < 4:
                continue
            both = len(a & b)
            contained, jaccard = both / min(len(a), len(b)), both / len(a | b)
            mixed = 0.65 * contained + 0.35 * jaccard if both >= 5 and contained >= 0.85 and jaccard >= 0.55 else 0.0
            upper = 2 * min(len(x), len(y)) / (len(x) + len(y))
            m = SequenceMatcher(None, x, y)
            ratio = m.ratio() if upper >= 0.92 and m.quick_ratio() >= 0.92 else 0.0
            if max(mixed, ratio if ratio >= 0.92 else 0.0) > 0:
                scores.append((-max(mixed, ratio if ratio >= 0.92 else 0.0), r))
        scores.sort()
        if scores and -scores[0][0] + (scores[1][0] if len(scores) > 1 else 0.0) >= 0.03:
            want.add((k, scores[0][1], round(-scores[0][0], 6)))
    assert got == want and len(want) > 10 and 100 in {k for k, _, _ in want}


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "a long, b string")
    jsonl.write_jsonl(df, str(tmp_path / "x"))
    jsonl.write_jsonl(df, str(tmp_path / "x"), append=True)
    assert jsonl.read_jsonl(spark, str(tmp_path / "x"), "a long, b string").count() == 4
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a long").collect()
    jsonl.write_stage(df, str(tmp_path / "s"), {"k": 1})
    assert jsonl.read_stage(spark, str(tmp_path / "s"), {"k": 1}).count() == 2
    with pytest.raises(ValueError, match="written with"):
        jsonl.read_stage(spark, str(tmp_path / "s"), {"k": 2})
    with pytest.raises(Exception, match="repeated"):
        jsonl.unique_by(df.unionByName(df), "a").collect()
    assert jsonl.without(df, df.where("a = 1"), "a").count() == 1


def test_providers(spark):
    pairs = spark.createDataFrame([("a b", "b c"), ("a b", "b c"), ("x", None)], "query string, document string")
    scored = providers.score_pairs(pairs, providers.provider("scorer", "Token-F1"))
    assert sorted(r["score"] for r in scored.collect()) == [0.0, 0.5, 0.5]
    cache = scored.select("pair_key", "score").distinct()
    again = providers.score_pairs(pairs, lambda q, d: 1 / 0, cache=cache)
    assert sorted(r["score"] for r in again.collect()) == [0.0, 0.5, 0.5]
    with pytest.raises(ValueError, match="no parser"):
        providers.provider("parser", "x")
    assert providers.fetch_status(b"%PDF-1", None)[0] and not providers.fetch_status(b"<html>", "text/html")[0]


def test_stream_is_batch(spark, tmp_path):
    rows = [(k % 7, k, f"v{k}") for k in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "id long, at long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: incremental.stage_stream(spark, str(tmp_path / "in"), "id long, at long, v string", files_per_batch=3)
    incremental.upsert(stream(), "id", "at", str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    batch = incremental.latest(spark.createDataFrame(rows, "id long, at long, v string"), "id", "at")
    same = lambda df: sorted(map(tuple, df.select("id", "at", "v").collect()))
    assert same(incremental.current(spark, str(tmp_path / "out"))) == same(batch)
    for _ in range(2):  # the second run finds nothing new
        incremental.append_new(stream(), "id", str(tmp_path / "new"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "new")).count() == 7


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    sink, schema = str(tmp_path / "sink"), "id long, at long, v string"
    files = lambda: {f"{p.parent.name}/{p.name}": p.parent.parent.name for p in (tmp_path / "sink" / "rows").glob("*/*/part-*")}
    live = lambda: {p.rsplit("/", 3)[1] + p.rsplit("/", 1)[1] for p in incremental.current(spark, sink).inputFiles()}
    rows = [(k, 1, f"a{k}") for k in range(100)]
    incremental.merge_batch(spark.createDataFrame(rows, schema), 0, "id", "at", sink, 16)
    before, first = files(), live()
    incremental.merge_batch(spark.createDataFrame([(3, 2, "b3"), (3, 1, "late"), (1000, 1, None)], schema), 1, "id", "at", sink, 16)
    want = {**{k: (1, f"a{k}") for k in range(100)}, 3: (2, "b3"), 1000: (1, None)}
    read = lambda: {r["id"]: (r["at"], r["v"]) for r in incremental.current(spark, sink).collect()}
    assert read() == want
    assert len(first & live()) >= len(first) - 2 and len(live() - first) <= 2  # one or two buckets have new files
    after = files()
    assert before.items() <= after.items()
    incremental.merge_batch(spark.createDataFrame([(3, 9, "replayed")], schema), 1, "id", "at", sink, 16)
    assert read() == want and files() == after
    (tmp_path / "sink" / "rows" / "g00000002").mkdir()  # a run that was lost before its commit
    incremental.merge_batch(spark.createDataFrame([(7, 0, "older"), (8, 5, "c8")], schema), 2, "id", "at", sink, 16)
    assert read() == want | {8: (5, "c8")}
    with pytest.raises(ValueError, match="16 buckets"):
        incremental.merge_batch(spark.createDataFrame(rows, schema), 3, "id", "at", sink, 8)
    incremental.merge_batch(spark.createDataFrame([], schema), 3, "id", "at", sink, 16)
    assert read() == want | {8: (5, "c8")}


def test_windowed_counts(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "e"))
    query = incremental.windowed_counts(events).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "e")).count()


def test_plan(spark):
    papers = spark.createDataFrame([(k, f"Title {k}\nthe model reaches score {k}\n| a | b |\n[1] Someone, a paper\nword{k} again") for k in range(6)], "paper_id long, text string")
    questions = spark.createDataFrame([("q1", "Which score reaches the model word3?"), ("q2", "word5")], "query_id string, question string")
    got = evidence(questions, papers, EvidenceOptions(top_papers=2, packages=3)).collect()
    assert {r["query_id"] for r in got} == {"q1", "q2"} and all(r["place"] <= 3 for r in got)
    assert routed(questions).count() == 2
    assert units(records_of(papers).select("paper_id", "record_id", "page", "text")).count() == 6
    assert isinstance(got[0].asDict(), dict) and pd.DataFrame([r.asDict() for r in got])["score"].between(0, 1).all()
