"""Standardised documents, counted answers, prompt audits, hierarchy levels and bounded BM25: hand-worked cases and plain loops."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import audit as A, bm25, counting as N, levels as H, standardizer as Z

ELEMENT = "paper_id string, at long, page long, element_type string, backend_type string, label string, text string"


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Tiny tables through wide plans: generating code takes longest."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


def records(spark, *elements):
    rows = [("p", k, *e) for k, e in enumerate(elements, 1)]
    return Z.standardized(spark.createDataFrame(rows, ELEMENT)).orderBy("reading_order").collect()


def test_prose_that_names_an_equation_stays_prose_and_points_to_it(spark):
    got = records(spark, (1, "text", "text", None, "As Equation (11) and Eq. 11. show"), (1, "text", "formula", None, "x = y (Eq. (4))"), (2, "text", None, None, "see Equation 4"), (None, "text", None, None, "Eq. 9 without a page"))
    assert [(r["record_type"], r["source_type"], r["label"]) for r in got[:4]] == [("paragraph", "text_span", None), ("equation", "equation_algorithm", "Equation 4"), ("paragraph", "text_span", None), ("paragraph", "text_span", None)]
    assert [(r["page"], r["record_type"], r["label"], r["record_id"], r["source_at"]) for r in got[4:]] == [(1, "equation", "Equation 0", "p001_r0005", 2), (1, "equation_reference", "Equation 11", "p001_r0006", 1), (2, "equation_reference", "Equation 4", "p002_r0007", 3)]
    assert got[5]["locator"]["equation_id"] == "Equation 11" and "formula_unavailable" in got[5]["warnings"] and got[3]["locator"]["page"] == -1 and got[3]["record_id"] == "p000_r0004"


def test_formulas_without_a_number_and_mathematical_prose(spark):
    got = records(spark, (1, "text", "formula", None, "E = mc"), (2, "text", "text", None, "we set alpha = 0.5 in every run of it"), (2, "text", "text", None, "and beta = 0.7 in another run"), (3, "text", "text", None, "alpha = 1"), (4, "text", "code", None, "Algorithm 2 Search"), (4, "text", "code", None, "for x in y"))
    assert (got[0]["label"], got[0]["rules"][-1]) == ("Equation 0", "unnumbered_formula_is_equation_0")
    assert got[4]["locator"]["algorithm_id"] == "Algorithm 2" and got[5]["record_type"] == "paragraph"
    assert [(r["page"], r["label"], r["source_at"], r["rules"]) for r in got[6:]] == [(2, "Equation 0", 2, ["mathematical_text_is_equation_0"])]


def test_printed_reference_numbers_and_continuations(spark):
    got = records(spark, (9, "text", None, None, "References"), (9, "text", None, None, "[12] A. Author, a title that goes on"), (9, "text", None, None, "continuation on the next column."), (9, "text", None, None, "short"), (9, "text", None, None, "B. Author, another title of 2021"), (9, "text", None, None, "Appendix"), (9, "text", None, None, "this long paragraph is no reference"), (9, "text", None, None, "Bibliography"), (9, "text", None, None, "lower case but the first of its list"))
    own = [r for r in got if r["record_type"] == "reference_entry"]
    assert [r["label"] for r in own] == ["Reference 12", "Reference 13", "Reference 14"]
    assert own[0]["text"].endswith("goes on continuation on the next column.") and "continuation_merged" in own[0]["rules"]
    assert [r["locator"]["citation_id"] for r in own] == ["12", "13", "14"]
    assert len(got) == 8


def test_captions_without_their_objects(spark):
    got = records(spark, (1, "text", "caption", None, "Table 1: lost"), (1, "table", "table", None, "Table 2 | a"), (1, "text", "caption", None, "Table 2: held"), (2, "text", "caption", None, "Table 1 again"), (2, "text", "caption", None, "Fig. 3(b) lost"), (2, "text", "text", None, "Figure 9 is prose"), (2, "table", "table", "Table 7", "  "))
    assert [(r["record_type"], r["label"], r["page"], r["reading_order"]) for r in got[6:]] == [("figure", "Figure 3(b)", 2, 7), ("table_caption", "Table 1", 1, 8)]
    status = Z.page_status(spark.createDataFrame([("p", 1, None, "text", None, None, "a"), ("p", 2, 3, "text", None, None, "b")], ELEMENT), Z.standardized(spark.createDataFrame([("p", 2, 3, "text", None, None, "b")], ELEMENT)))
    assert sorted((r["page"], r["n_records"], r["n_missing"], r["status"]) for r in status.collect()) == [(-1, 0, 1, "failed"), (3, 1, 0, "complete")]


CATALOG = "query_id string, at long, ref string, paper_id string, source_type string, label string, text string, citation_id string, section_title string, section_id string"


def counted(spark, question, rows, papers=None):
    catalog = [("q", k, f"E{k}", *r) for k, r in enumerate(rows)]
    got = N.counts(spark.createDataFrame([("q", question, papers)], "query_id string, question string, papers array<string>"), spark.createDataFrame(catalog, CATALOG)).collect()
    return [(r["rule"], r["value"], r["refs"]) for r in got]


def test_counts_and_their_refusals(spark):
    eq = lambda text, label="Equation 3": ("p", "equation_algorithm", label, text, None, None, None)
    ask = "How many parentheses are in Equation 3?"
    assert counted(spark, ask, [eq("(a) = (b) (3)")]) == [("parentheses", 2, ["E0"])]
    assert counted(spark, ask, [eq("Equation 3 ( was not emitted = "), eq("no operator (x)"), eq("(a) = b", "Equation 4")]) == []
    cite = lambda n, text="A. Author, 2020", paper="p": (paper, "citation_context", None, text, n, None, None)
    ask = "What is the index of the last reference?"
    assert counted(spark, ask, [cite("1"), cite("#3"), cite("2"), cite("x")]) == [("last_reference", 3, ["E1"])]
    for bad in (["1", "3"], ["1", "2", "2"], ["2", "3"], ["x"]):
        assert counted(spark, ask, [cite(n) for n in bad]) == []
    assert counted(spark, ask, [cite("1"), cite("2", "Guidelines: 2020"), cite("7", paper="r")], ["p"]) == [("last_reference", 1, ["E0"])]
    ask = "How many references include Smith as an author?"
    assert counted(spark, ask, [cite("1", "Smith, J. 2020"), cite("2", "and smithers, 2019"), cite("3", "Jones, 2020"), cite("4", "Table 3 Smith 2020")]) == [("author", 2, ["E0", "E1"])]
    assert counted(spark, ask, [cite("1", "Jones, 2020")]) == []
    text = lambda t, s: ("p", "text_span", None, t, None, s, None)
    ask = "How many papers are cited in the Related Work section?"
    assert counted(spark, ask, [text("as (Lee et al., 2020; Kim, 2019) and (Kim, 2019)", "2 Related Work"), text("(Ng, 2018)", "Method")]) == [("cited_works", 2, ["E0"])]
    assert counted(spark, ask, [text("no work (2020) here", "Related Work")]) == [] and counted(spark, "Why?", [cite("1")]) == []


@pytest.mark.parametrize("changed", [None, *A.FIELDS])
def test_audit_of_every_field(spark, changed):
    kinds = {"page": "long", "reading_order": "long", "document_order": "long", "locator": "struct<page:long,table_id:string>", "section_path": "array<string>"}
    schema = "query_id string, evidence_ref string, image_ref string, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in A.FIELDS)
    value = {"page": 3, "reading_order": 4, "document_order": None, "locator": (3, None), "section_path": ["a", "b"], "label": None}
    other = {"page": None, "reading_order": 5, "document_order": 0, "locator": (3, "Table 1"), "section_path": ["a"], "label": ""}
    row = lambda own: ("q", "E1", "I1", *[own.get(f, value.get(f, "same")) for f in A.FIELDS])
    selected = spark.createDataFrame([row({})], schema)
    packets = spark.createDataFrame([row({changed: other.get(changed, "other")} if changed else {})], schema)
    images = spark.createDataFrame([("q", "I1", True)], "query_id string, image_ref string, exists boolean")
    found = [(r["ref"], r["problem"]) for r in A.audit_findings(selected, packets, images).collect()]
    if changed:
        assert found == [("E1", f"field {changed}")]
        with pytest.raises(Exception, match=f"prompt audit: q E1 field {changed}"):
            A.audited(selected, packets, images).collect()
    else:
        assert found == [] and [tuple(r) for r in A.audited(selected, packets, images).collect()] == [("q", 1, 1, 1)]
        twice = A.audit_findings(selected.union(selected), packets.where("false"), images.where("false")).collect()
        assert sorted(r["problem"] for r in twice) == ["image not attached", "not in packets", "selected: repeated ref"]


RECORD = "paper_id string, record_id string, at long, page long, section_id string, section_title string, section_path array<string>, record_type string, source_type string, label string, text string, crop_path string, citation_id string"


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(p, f"{p}{k:02}", k + 1, rng.choice([None, 1, 2, 3]), rng.choice([None, "s", "t"]), None, None, "paragraph", None, None, rng.choice(["text", "text", " "]), None, None) for p in "abc" for k in range(30)]
    usable = [r for r in rows if r[10].strip()]
    anchors = [("q", r[1], r[0], r[2], r[3], r[4]) for r in rows if rng.random() < 0.5] + [("q", "gone", "a", 7, 2, "s"), ("other", "gone", "zz", 1, 1, "s")]
    for limit in (1, 2, 5):
        got = collections.defaultdict(list)
        for r in H.neighbours(spark.createDataFrame(anchors, "query_id string, record_id string, paper_id string, at long, page long, section_id string"), spark.createDataFrame(rows, RECORD), limit).orderBy("place").collect():
            got[r["query_id"], r["anchor_id"]].append(r["record_id"])
        for q, i, paper, at, page, section in anchors:
            own = sorted((r for r in usable if r[0] == paper and r[1] != i), key=lambda r: ((r[4] or "") != (section or ""), (r[3] or 0) != (page or 0), abs(r[2] - at), r[2], r[3] or 10**9, r[1]))  # noqa: B023
            assert got[q, i] == [r[1] for r in own[:limit]], (i, limit)


def test_levels_of_a_question(spark):
    rec = lambda p, k, text, kind="paragraph", label=None, title="Method", cid=None, crop=None, page=1: (p, f"{p}{k}", k, page, title, title, ["1", title], kind, None, label, text, crop, cid)
    rows = [rec("a", 1, "before it"), rec("a", 2, "Caption\n| x | y |\n|---|---|\n| 1 | 2 |", "table", "Table 1"), rec("a", 3, "behind it " * 30), rec("a", 4, "far", title="Other", page=2), rec("b", 1, "EasySpec speeds decoding"), rec("b", 2, "[7] K. Lee", "reference", "Reference 7", "References", "7", page=9), rec("b", 3, "nothing", title="End", page=9)]
    stale = rec("a", 2, "old text", "table", "Table 9")
    selected = spark.createDataFrame([("q", 1, None, *stale), ("q", 2, 5, *rec("z", 1, "a record that is gone", "figure", "Figure 1", crop="x.png"))], "query_id string, place long, selection_rank long, " + RECORD)
    questions = spark.createDataFrame([("q", "What does the 7th reference of EasySpec say of decoding?")], "query_id string, question string")
    papers = spark.createDataFrame([("q", "b", "EasySpec: a title", "An abstract"), ("q", "a", "Other", None)], "query_id string, paper_id string, title string, abstract string")
    level0, links = H.catalog_levels(selected, questions, papers, spark.createDataFrame(rows, RECORD))
    own = {r["record_id"]: r for r in level0.collect()}
    assert {i: r["role"] for i, r in own.items()} == {"a2": "selected_anchor", "z1": "selected_anchor", "a1": "l1_context", "a3": "l1_context", "b2": "deterministic_navigation", "b1": "l1_context", "b3": "l1_context"}
    assert own["a2"]["label"] == "Table 1" and own["a2"]["selection_rank"] == 1 and own["z1"]["selection_rank"] == 5
    assert own["b2"]["reasons"] == ["explicit_citation_id:7"] and own["b1"]["reasons"] == ["lexical_text_navigation"]
    assert [r["record_id"] for r in level0.orderBy("evidence_ref").collect()] == ["a1", "b1", "z1", "a2", "b2", "a3", "b3"]
    level1 = {r["anchor_ref"]: r for r in H.contexts(level0, links, most=20).collect()}
    table = level1[own["a2"]["evidence_ref"]]
    assert table["table"].asDict() == {"caption": "Caption", "columns": ["x", "y"], "rows": [["1", "2"]]} and table["heading_path"] == ["1", "Method"]
    assert table["neighbor_refs"] == [own["a1"]["evidence_ref"], own["a3"]["evidence_ref"]] and table["neighbor_excerpts"] == ["before it", "behind it behind..."]
    assert level1[own["z1"]["evidence_ref"]]["figure"].asDict() == {"caption": "a record that is...", "has_crop": True}
    assert level1[own["b2"]["evidence_ref"]]["citation"] == "[7] K. Lee"
    tight = {r["anchor_ref"]: r["neighbor_excerpts"] for r in H.contexts(level0, links, most=20, budget=15).collect()}
    assert tight[own["a2"]["evidence_ref"]] == ["before it"]
    three = [x.collect() for x in H.navigation_levels(level0, papers, chars=8)]
    assert {(r["paper_id"], r["abstract_preview"]): r["counts"] for r in three[0]} == {("a", ""): {"table": 1, "text_span": 2}, ("b", "An ab..."): {"citation_context": 1, "text_span": 2}, ("z", ""): {"figure": 1}}
    assert {(r["paper_id"], r["section_id"]): r["anchor_refs"] for r in three[1]}["a", "Method"] == [own["a2"]["evidence_ref"]]
    assert [(r["evidence_ref"], r["entity"]) for r in sorted(three[2], key=lambda r: r["place"])] == [(own["b1"]["evidence_ref"], "EasySpec"), (own["a2"]["evidence_ref"], "Caption"), (own["b2"]["evidence_ref"], "Lee")]


def test_cards_are_merged_as_a_loop_would(spark):
    rng = random.Random(8)
    verified, extractive = [], []
    for q in (f"q{i}" for i in range(25)):
        for rows, chance in ((verified, 0.5), (extractive, 1)):
            if rng.random() < chance:
                rows += [(q, f"C{k:03}", k, rng.sample("abcdefg", rng.randint(0, 3))) for k in range(1, rng.randint(2, 7))]
    schema, most = "query_id string, card_id string, place long, claims array<string>", 5
    got = collections.defaultdict(list)
    for r in H.attached_cards(spark.createDataFrame(verified, schema), spark.createDataFrame(extractive, schema), most).orderBy("place").collect():
        got[r["query_id"]].append((r["card_id"], r["source"], r["own"]))
    for q in {r[0] for r in verified + extractive}:
        good, rest = ([r for r in rows if r[0] == q] for rows in (verified, extractive))
        want = [(c, "verified", c) for _, c, _, _ in good] or [(c, "extractive", c) for _, c, _, _ in rest]
        seen = {x for r in good for x in r[3]}
        for _, c, _, claims in rest if good else []:
            if len(want) < most and set(claims) - seen:
                want.append((f"C{len(want) + 1:03d}", "added", c))
                seen |= set(claims)
        assert got[q] == want[:most], q


def test_bounded_bm25_has_the_best_of_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(120)], k=n))
    docs = [(k, text(rng.randint(1, 40))) for k in range(400)] + [(500 + k, "w3 w5 w5") for k in range(6)] + [(600, None), (601, "")]
    asked = [(q, text(rng.randint(1, 12))) for q in range(15)] + [(20, "w3 w5"), (21, "unknown"), (22, None), (23, "w119 w118")]
    d, q = spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(asked, "q long, text string")
    for k in (1, 3, 10):
        want = bm25.top_k(bm25.bm25_scores(d, q, doc_key="d", query_key="q"), k, query_key="q", doc_key="d")
        got = bm25.bm25_top_k(d, q, k, doc_key="d", query_key="q")
        key = lambda df: sorted((r["q"], r["rank"], r["d"], r["score"]) for r in df.select("q", "rank", "d", F.round("score", 5).alias("score")).collect())
        assert key(got) == key(want)
    p = bm25.postings(d, q, doc_key="d", query_key="q")
    assert bm25.candidates(p, 3).count() < 0.5 * bm25.bm25_scores(d, q, doc_key="d", query_key="q").count()
