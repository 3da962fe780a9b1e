"""What must be done once a row or once a table: plans of small tables, and their rows."""

import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators import coverage as C, evaluation as EV, hybrid as HY, levels as LV, matching as M, objects as O, scoring as SC, slots as S
from evidentia.operators.text import counted
from evidentia.queries import QUERIES, slots as SQ


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_virtual_records_in_one_pass(spark, tmp_path):
    rows = [(1, "paragraph", "", "see Table 3 and Fig. 2"), (2, "table", "Table 3", "| a | b | c |"), (3, None, None, None)]
    spark.createDataFrame(rows, "record_id long, kind string, label string, text string").write.parquet(f"{tmp_path}/records")
    made = M.with_virtual(spark.read.parquet(f"{tmp_path}/records"))
    assert plan(made).count("FileScan") == 1
    own = [("1", "paragraph", "", "record", 0), ("2", "table", "Table 3", "record", 0), ("3", None, None, "record", 0)]
    hints = [("1__hint_figure", "figure", "Figure 2", "hint of 1", 2), ("1__hint_table", "table", "Table 3", "hint of 1", 1)]
    assert sorted((tuple(r) for r in made.select("record_id", "kind", "label", "origin", "hint").collect()), key=str) == sorted(own + hints, key=str)


def test_difference_cuts_a_table_once(spark):
    table = "| Set | A | B |\n|---|---|---|\n| one | 7 | 7 |\n| two | 9 | 9 |\n| absolute delta | n/a | 2 |\n| absolute Δ | -2 | 3 |"
    rows = spark.createDataFrame([(table, "7", " 9 "), (table, "7", "8"), (table, "", "9"), (None, "7", "9"), (table, None, "9")], "t string, a string, b string")
    made = rows.select(S.reported_difference(F.col("t"), F.col("a"), F.col("b")).alias("v"))
    assert plan(made).count("split(") <= 2  # lines, and cells of a line
    assert [r["v"] for r in made.collect()] == ["2", None, None, None, None]


def test_equations_without_a_join(spark):
    texts = [(1, 1, "y = f(x) (3)"), (1, 2, "Algorithm 2 Input: x"), (1, 3, "a = b"), (1, 4, "c = d"), (1, 5, "prose alone"), (2, 1, "y = f(x) (3)"), (2, 2, "y = f(x) (3)"), (2, 3, None)]
    b = spark.createDataFrame([(p, 1, at, t) for p, at, t in texts], "paper_id long, page long, at long, text string")
    rows = O.equations(b, b.where("paper_id = 1"))
    assert "Join" not in plan(rows)
    assert sorted(tuple(r) for r in rows.select("paper_id", "kind", "label", "at", "rule").collect()) == [(1, "algorithm", "Algorithm 2", 2, "block"), (1, "equation", "Equation 3", 1, "block"), (2, "equation", "Equation 3", 1, "block"), (2, "equation", "Equation 3", 2, "block")]


def test_nearest_pairs_by_blocks(spark):
    vectors = [(k, [float(k % 7), 1.0, float(k % 3)], 1) for k in range(40)] + [(50, [1.0, None, 2.0], 1), (51, None, 1)]
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in SC.nearest_pairs(e.where("vec_id in (0, 50)").selectExpr("vec_id AS query_id", "embedding AS q"), e.select("vec_id", "embedding"), 3).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert {21, 50, 51} <= set(got[0])  # the copy and those without a product
    assert len(got[0]) == 5 and len(got[50]) == 41
    p = plan(QUERIES["dense_topk"](spark, "/root/testdata/sf0.001"))
    assert "NestedLoop" not in p and "Cartesian" not in p


@pytest.mark.parametrize("name", ["grounded_predictions", "window_expansions", "package_members"])
def test_lines_are_made_once(spark, name):
    """What a query reads several times is written before, so its last plan reads no lines."""
    assert "lineitem" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_words_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["a"],)], "w array<string>").select(counted(F.col("w")).alias("c"))
    assert "Exchange" not in plan(rows)
    assert [None if r["c"] is None else [tuple(x) for x in r["c"]] for r in rows.collect()] == [[("a", 1), ("b", 2)], [], None, [("a", 1)]]


def test_packages_are_dealt_once(spark):
    """Counts, rankings and places of a question's packages stay where its rows are: two joins make lines, one exchange deals them."""
    rows = QUERIES["selected_packages"](spark, "/root/testdata/sf0.001")
    assert plan(rows).split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 8
    assert rows.count() > 0


def test_sets_are_made_once(spark):
    assert "lineitem" not in plan(QUERIES["max_coverage_dp"](spark, "/root/testdata/sf0.001"))
    rows = [(1, None, ["a"]), (1, 2, ["a", "b"]), (1, 3, ["b", "a"]), (1, 4, ["c"]), (1, 5, []), (2, 6, ["a"]), (3, 7, []), (None, 8, ["a"]), (None, 9, ["a", "b"])]
    sets = spark.createDataFrame(rows, "k long, m long, items array<string>").selectExpr("k", "m", "array_sort(items) AS items")
    assert sorted(((r["k"] or 0, r["m"]) for r in C.undominated(sets, "k", "m").collect())) == [(0, 8), (0, 9), (1, 2), (1, 4), (2, 6)]
    assert sorted((r["k"] or 0, r["covered"]) for r in C.max_coverage(sets.where("k IS NOT NULL"), "k", "m", 1).collect()) == [(1, 2), (2, 1), (3, 0)]


def test_table_rows_meet_without_a_join(spark):
    assert "Join" not in plan(QUERIES["table_row_scores"](spark, "/root/testdata/sf0.001"))
    name = "k long, key string, line long, a double, b string"
    gold = [(1, "x", 1, 1.0, "p"), (1, " X", 2, 2.0, "q"), (1, "y", 3, None, None), (1, None, 4, 5.0, "r"), (2, "z", 5, 1.0, "p"), (None, "x", 6, 1.0, "p")]
    pred = [(1, "x", 1, 2.0, "Q"), (1, "w", 2, 9.0, "q"), (3, "x", 3, 1.0, "p")]
    got = EV.table_scores(spark.createDataFrame(gold, name), spark.createDataFrame(pred, name), "k", "key", {"a": "number", "b": "string"}).collect()
    assert [(r["k"], round(r["precision"], 3), r["cell_total"]) for r in sorted(got, key=lambda r: r["k"])] == [(1, 0.5, 6), (2, 0.0, 2)]


RECORD = "paper_id string, record_id string, at long, page long, section_id string, section_title string, section_path array<string>, record_type string, source_type string, label string, text string, crop_path string, citation_id string"


def test_neighbours_are_found_where_a_paper_is(spark):
    """One exchange by paper and no join: an anchor's places around it are no rows. Anchors given twice and those that no record is."""
    rows = spark.createDataFrame([("a", f"a{k}", k, 1 + k // 3, "s" if k % 2 else "t", None, None, "paragraph", None, None, "text", None, None) for k in range(9)], RECORD)
    anchors = spark.createDataFrame([("q", "a4", "a", 4, 2, "t")] * 2 + [("p", "a4", "a", 4, 2, "t"), ("q", "gone", "a", 4, 2, "t")], "query_id string, record_id string, paper_id string, at long, page long, section_id string")
    near = LV.neighbours(anchors, rows, 2)
    assert plan(near).split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan(near)
    got = sorted(tuple(r) for r in near.select("query_id", "anchor_id", "place", "record_id").collect())
    assert got == sorted((q, i, 1 + k, r) for q, i, own in (("q", "a4", ("a2", "a6")), ("p", "a4", ("a2", "a6")), ("q", "gone", ("a4", "a2"))) for k, r in enumerate(own))


def test_a_record_that_is_gone_is_in_the_catalog_once(spark):
    gone = ("a", "a1", 1, 1, "s", "S", None, "paragraph", None, None, "text", None, None)
    selected = spark.createDataFrame([("q", 2, None, *gone), ("q", 1, None, *gone)], "query_id string, place long, selection_rank long, " + RECORD)
    questions, papers = spark.createDataFrame([("q", "What?")], "query_id string, question string"), spark.createDataFrame([("q", "a", "T", None)], "query_id string, paper_id string, title string, abstract string")
    level0, _ = LV.catalog_levels(selected, questions, papers, spark.createDataFrame([], RECORD))
    assert [(r["evidence_ref"], r["record_id"], r["selection_rank"]) for r in level0.collect()] == [("E0001", "a1", 1)]


def level0_of(spark):
    rows = [("q", f"r{k}", f"E{k:04}", "selected_anchor" if k < 3 else "l1_context", "text_span" if k % 2 else "table", "a", "s" if k < 4 else None, "S", None, f"Text {k} of CLIP and BERT", None, None) for k in range(6)]
    return spark.createDataFrame(rows, "query_id string, record_id string, evidence_ref string, role string, kind string, paper_id string, section_id string, section_title string, section_path array<string>, text string, label string, crop_path string")


def test_contexts_meet_where_a_question_is(spark):
    links = spark.createDataFrame([("q", "r1", "r5", 2), ("q", "r1", "r4", 1), ("q", "r0", "r4", 1), ("q", "r4", "r3", 1), ("q", "r2", "not there", 1), ("other", "r1", "r2", 1)], "query_id string, anchor_id string, record_id string, place long")
    rows = LV.contexts(level0_of(spark), links, most=9)
    assert plan(rows).split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan(rows)
    assert {r["anchor_ref"]: (r["neighbor_refs"], r["neighbor_excerpts"]) for r in rows.collect()} == {"E0000": (["E0004"], ["Text 4..."]), "E0001": (["E0004", "E0005"], ["Text 4...", "Text 5..."]), "E0002": ([], []), "E0004": (["E0003"], ["Text 3..."])}
    assert {r["anchor_ref"]: r["neighbor_refs"] for r in LV.contexts(level0_of(spark), links, most=9, budget=9).collect()} == {"E0000": ["E0004"], "E0001": ["E0004"], "E0002": [], "E0004": ["E0003"]}


def test_navigation_counts_in_one_pass(spark):
    candidates = spark.createDataFrame([("q", "a", "A title", "abstract")], "query_id string, paper_id string, title string, abstract string")
    papers, sections, mentions = LV.navigation_levels(level0_of(spark), candidates, chars=0)
    assert plan(sections).split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan(sections)
    assert [r["counts"] for r in papers.collect()] == [{"table": 3, "text_span": 3}]
    assert sorted((r["section_id"], r["anchor_refs"], r["counts"]) for r in sections.collect()) == [("", [], {"table": 1, "text_span": 1}), ("s", ["E0000", "E0001", "E0002"], {"table": 2, "text_span": 2})]
    assert [(r["place"], r["evidence_ref"], r["entity"]) for r in mentions.orderBy("place").collect()] == [(3 * k + i + 1, f"E{k:04}", w) for k in range(6) for i, w in enumerate(("Text", "CLIP", "BERT"))]


def test_what_is_asked_is_not_broadcast(spark):
    """Neither questions with their routes nor parts meet the packages through the driver."""
    assert "BroadcastExchange" not in plan(QUERIES["selected_packages"](spark, "/root/testdata/sf0.001"))


def test_titles_are_cut_once(spark):
    """Hybrid retrieval makes a title's words once a row, and no shuffle has a pair of a question and a paper as its key."""
    made = HY.with_aliases(spark.createDataFrame([(1, "Deep Nets for Vision", "about CLIP")], "paper_id long, title string, abstract string"))
    assert made.select("aliases")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(") == 1
    assert set(made.first()["aliases"]) == {"dnv", "dn", "nv", "clip"}
    rows = QUERIES["hybrid_retrieval"](spark, "/root/testdata/sf0.001")
    assert not re.search(r"Exchange hashpartitioning\(\w+#\d+L?, \w+#\d+L?, \d+\)", plan(rows))


def test_members_are_dealt_by_anchor_once(spark):
    """A member brings its place with it: after all joins one exchange, by anchor."""
    p = plan(QUERIES["package_members"](spark, "/root/testdata/sf0.001")).split("Initial Plan")[-1]
    assert not re.search(r"Exchange hashpartitioning\(anchor_id#\d+, record_id#\d+, \d+\)", p)
    assert p.index("Exchange hashpartitioning(anchor_id") < p.index("Union") < p.index("Join")


def test_windows_are_written_without_their_lines(spark, monkeypatch):
    seen, write = {}, SQ.staged
    monkeypatch.setattr(SQ, "staged", lambda df, name: seen.update({name: df.columns}) or write(df, name))
    assert QUERIES["window_expansions"](spark, "/root/testdata/sf0.001").columns == ["query_id", "level", "triple_id", "window_id", "refs"]
    assert sorted(seen["windows"]) == ["anchor_quote", "anchor_ref", "query_id", "support_refs", "window_id"]
