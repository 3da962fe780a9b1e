"""The whole evaluation on a few hand-worked questions."""

from evidentia.plans.official import SCHEMA, evaluate, violations

PAGE = lambda page, **k: (page, k.get("section"), k.get("table"), None, None, k.get("algorithm"), None)


def test_evaluate(spark):
    gold = spark.createDataFrame(
        [
            ("q1", 1, None, ["a", "b"], [("a", "table", PAGE(2, table="Table 3"))], "B", None),
            ("q2", 2, ["papers"], ["c"], [], None, "Some  Text"),
            ("q3", 3, None, [], [("d", "equation_algorithm", PAGE(0, section="Method", algorithm="3"))], None, "Yes"),
        ],
        SCHEMA,
    )
    pred = spark.createDataFrame(
        [
            ("q1", 1, None, ["x"], [], "A", None),
            ("q1", 2, None, ["a", " b ", ""], [("a", "table", PAGE(2, table="3")), ("a", "table", PAGE(None))], "b", None),
            ("q3", 3, None, ["z"], [("d", "equation_algorithm", PAGE(None, section="Method", algorithm="equation 3"))], None, " 'yes' "),
            ("q9", 4, None, ["z"], [], None, None),
        ],
        SCHEMA,
    )
    got = evaluate(gold, pred)
    papers, evidence, answers = (got[k].first() for k in ("papers", "evidence", "answers"))
    assert (papers["precision"], papers["recall"], papers["f1"]) == (round(1 / 3, 6), round(2 / 3, 6), round(1 / 3, 6))
    assert (evidence["precision"], evidence["recall"], evidence["n"]) == (1.0, 1.0, 2)
    assert (answers["choice_accuracy"], answers["freeform_match"]) == (1.0, 1.0)
    assert [r["query_id"] for r in got["missing"].collect()] == ["q2"] and [r["query_id"] for r in got["extra"].collect()] == ["q9"]
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    rules = {(r["key"], r["rule"]) for r in violations(gold, pred, known).collect()}
    assert {("q2", "missing_prediction"), ("q9", "unknown_query"), ("q1", "repeated_query"), ("q3/d", "evidence_of_other_paper"), ("q3/z", "unknown_paper")} <= rules
