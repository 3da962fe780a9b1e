"""Package building and selection: hand-worked cases, and random ones against a plain loop over all rankings."""

import collections
import math
import random
import re

import pytest

from evidentia.functions import labels as L
from evidentia.operators import packages as P


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Tiny tables through wide plans: generating code takes longest."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


RECORD = "paper_id string, record_id string, page long, reading long, record_type string, source_type string, section_id string, label string, text string"
PACKAGE = "query_id string, package_id string, at long, paper_id string, page long, kind string, label string, section_type string, section_title string, columns array<string>, text string, score double, visual double"
QUESTION = "query_id string, question string, hint string, kinds array<string>, several boolean"
ROUTE = "query_id string, way string, route long, text string, kinds array<string>, paper_id string"


def built(spark, records, neighbours=1):
    rows = P.canonical(spark.createDataFrame(records, RECORD))
    out = collections.defaultdict(list)
    for r in P.package_records(rows, rows, neighbours).orderBy("anchor_id", "place").collect():
        out[r["anchor_id"]].append(r["record_id"])
    return out


def test_packages_hold_what_explains_their_anchor(spark):
    para = lambda i, at, text, sec="s": ("p", i, 1, at, "paragraph", None, sec, None, text)
    got = built(spark, [para("t1", 1, "before"), ("p", "tab", 1, 2, "table", None, "s", "Table 3", "a | b"), para("t2", 3, "after"), ("p", "cap", 1, 9, "table_caption", None, "z", "table  3", "caption"), ("p", "x", 1, 4, "page_number", None, "s", None, "4"), (None, "", 1, 5, "paragraph", None, "s", None, "no id")])
    assert got["tab"] == ["t1", "tab", "t2", "cap"]
    assert got["t1"] == ["t1", "tab"] and got["t2"] == ["tab", "t2"]
    assert "x" not in got and "" not in got
    narrated = built(spark, [para("near", 1, "close by"), ("p", "fig", 1, 2, "figure", None, "s", "Figure A.2", ""), para("after", 3, "close, too"), para("told", 9, "as fig. A.2 shows", "t"), para("other", 8, "see Figure 12", "t")])
    assert narrated["fig"] == ["fig", "told"]
    cited = built(spark, [("p", "c", 1, 1, "citation_context", None, "s", None, "as in [7]"), ("p", "r7", 9, 1, "reference", None, "refs", "Reference 7", "[7] A. Author"), ("p", "r8", 9, 2, "reference", None, "refs", "Reference 8", "[8] B."), ("p", "r7b", 9, 3, "reference", None, "refs", None, "[7] again")])
    assert cited["c"] == ["c", "r7"] and cited["r8"] == ["r8"] and cited["r7"] == ["c", "r7"]


def test_of_repeated_records_the_longest_stays(spark):
    rows = P.canonical(spark.createDataFrame([("p", "r", 1, 1, "paragraph", None, None, None, t) for t in ("ab", "abc", None)], RECORD)).collect()
    assert [r["text"] for r in rows] == ["abc"]


def pack(i, at, kind="text_span", paper="p", page=1, text="", label=None, score=None, visual=None, columns=None, section=None, query="q"):
    return (query, i, at, paper, page, kind, label, section, None, columns, text, score, visual)


def choose(spark, packages, question="what", routes=(), kinds=None, several=False, hint=None, **options):
    got = P.select_packages(spark.createDataFrame([("q", question, hint, kinds, several)], QUESTION), spark.createDataFrame(packages, PACKAGE), spark.createDataFrame([("q", *r) for r in routes], ROUTE), P.PackageOptions(**options)).collect()
    return [r["name"] for r in sorted((r for r in got if r["entry"] == "package"), key=lambda r: r["place"])], {r["name"]: r["detail"] for r in got if r["entry"] == "slot"}, next((r["name"] for r in got if r["entry"] == "stop"), None)


def test_selection_cases(spark):
    assert choose(spark, [pack("a1", 0, score=0.9), pack("a2", 1, score=0.8, page=2), pack("b", 2, paper="r", score=0.1)], several=True, budget=2, papers=2)[0] == ["a1", "b"]
    assert choose(spark, [pack("t", 0, score=0.9), pack("tab", 1, kind="table", label="Table 2", score=0.1)], "See Table 2", budget=1)[0] == ["tab"]
    assert choose(spark, [pack("x", 0, score=0.9), pack("y", 1, score=0.8), pack("z", 2, page=2, score=0.1)], budget=2, page_cap=1)[0] == ["x", "z"]
    assert set(choose(spark, [pack("one", 0, page=1, score=0.1), pack("two", 1, page=2, score=0.1)], budget=2, least=1, page_anchors=1)[0]) == {"one", "two"}
    assert set(choose(spark, [pack("direct", 0, text="apple", score=0.9), pack("aux", 1, text="banana", score=0.1)], "apple", [("claim", 1, "banana", None, None)], budget=2, page_cap=1)[0]) == {"direct"}
    assert choose(spark, [pack("direct", 0, text="apple", score=0.9), pack("aux", 1, page=2, text="banana", score=0.1)], "apple", [("claim", 1, "banana", None, None)], budget=2, least=1)[0] == ["direct", "aux"]
    names, slots, _ = choose(spark, [pack("t", 0, text="score", score=0.9), pack("tab", 1, kind="table", page=2, text="score", score=0.1)], "score", [("slot", 1, "score", ["table"], None), ("slot", 2, "score", ["figure"], None)], budget=1)
    assert names == ["tab"] and slots == {"slot:1": "served"}  # a slot without any package of its kind has no ranking
    names, slots, _ = choose(spark, [pack("e1", 0, kind="equation_algorithm", paper="dit", score=0.9), pack("e2", 1, kind="equation_algorithm", paper="roman", score=0.1)], routes=[("slot_paper", 1, "loss", ["equation_algorithm"], "roman")], budget=1)
    assert names == ["e2"] and slots == {"slot_paper:1": "served"}
    main = [pack("far", 0, kind="table", text="imagenet accuracy", columns=["x"]), pack("main", 1, kind="table", page=2, text="accuracy of all", columns=["CIFAR-10 acc"])]
    assert choose(spark, main, "which accuracy", [("slot_paper", 1, "accuracy on CIFAR-10", ["table"], "p")], budget=1)[0] == ["main"]
    ipc = [pack("far", 0, kind="table", text="tiny imagenet"), pack("main", 1, kind="table", page=2, text="x", columns=["Tiny ImageNet IPC 10"])]
    assert choose(spark, ipc, "value", [("slot_paper", 1, "dataset: Tiny ImageNet ipc = 10", ["table"], "p")], budget=1)[0] == ["main"]
    served = choose(spark, [pack("x", 0, text="a"), pack("y", 1, text="a b")], routes=[("fallback_slot", 1, "a", None, None), ("fallback_slot", 2, "b", None, None), ("fallback_slot", 3, "b", None, None)], budget=1, page_cap=2)
    assert served[0] == ["x", "y"] and served[1] == {"fallback_slot:1": "served", "fallback_slot:2": "served", "fallback_slot:3": "not served"}
    assert choose(spark, [pack("v", 0, kind="figure", score=0.5, visual=0.1), pack("w", 1, kind="figure", page=2, score=0.4, visual=0.9)], kinds=["figure"], budget=1)[0] == ["v"]
    assert choose(spark, [pack("a", 0, score=0.2)], budget=5)[2] == "no package on an open page"
    assert choose(spark, [pack(f"k{i}", i, page=i, score=1 - i / 10) for i in range(9)], least=3)[::2] == (["k0", "k1", "k2"], "everything asked for is there")


def test_context_keeps_packages_whole(spark):
    selected = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, package_id string, place long")
    members = spark.createDataFrame([("a", "r1", 1, 500), ("a", "r2", 2, 1), ("b", "r3", 1, 90), ("b", "r1", 2, 500), ("c", "r2", 1, 1), ("c", "r4", 2, 9)], "package_id string, record_id string, position long, size long")
    got = lambda n: [r["record_id"] for r in P.context_records(selected, members, n).orderBy("place", "record_id").collect()]
    assert got(100) == ["r1", "r2"] and got(510) == ["r1", "r2", "r4"] and got(0) == ["r1", "r2", "r3", "r4"]


# --- a plain loop


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def plain(question, packages, routes, o):
    _, query, hint, kinds, several = question
    n, docs = len(packages), [words(p["text"]) for p in packages]
    df, avg = collections.Counter(w for d in docs for w in set(d)), sum(map(len, docs)) / len(docs)

    def bm25(text):
        out = []
        for d in docs:
            tf, s = collections.Counter(d), 0.0
            for w in words(text):
                if tf[w]:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * max(1, len(d)) / max(avg, 1e-9)))
            out.append(round(s, 9))
        return out

    def ranked(text, keep):
        s = bm25(text)
        return sorted((i for i in range(n) if keep(packages[i])), key=lambda i: (-s[i], i))

    score = [p["score"] if p["score"] is not None else -1.0 for p in packages]
    ways = collections.defaultdict(list)
    rankings, said = [ranked(query, lambda p: True)], {query}
    for way, number, text, allowed, paper in sorted(routes, key=lambda r: r[1]):
        if way == "claim" and text in said:
            continue
        said |= {text} if way == "claim" else set()
        r = ranked(text, lambda p: (not allowed or p["kind"] in allowed) and (paper is None or p["paper_id"] == paper))  # noqa: B023
        if r:
            rankings.append(r)
            ways[way].append((number, r))
    for k in L.OFFICIAL_TYPES:
        rankings.append(ranked(f"{k} {query}", lambda p: p["kind"] == k))  # noqa: B023
    by = lambda rows, key: sorted(rows, key=lambda i: (-key(i), i))
    asked = sorted(set(kinds or [])) or ["text_span"]
    rankings.append(by(range(n), lambda i: score[i]))
    rankings += [by((i for i in range(n) if packages[i]["kind"] == k), lambda i: score[i]) for k in asked]
    rankings.append(by((i for i in range(n) if packages[i]["visual"] is not None), lambda i: packages[i]["visual"]))
    rankings.append(by(range(n), lambda i: (packages[i]["kind"] in asked) + 0.1 * (packages[i]["kind"] != "text_span" and bool(packages[i]["label"]))))
    pool = {i for r in rankings for i in (r[: o.pool] if o.pool > 0 else r)}
    rrf = collections.Counter()
    for r in rankings:
        for k, i in enumerate(r, 1):
            rrf[i] += 1 / (o.rrf_k + k)
    order = sorted(pool, key=lambda i: (-score[i], -round(rrf[i], 12), i))
    slots = [(w, x, r) for w in ("slot_paper", "slot", "fallback_slot") for x, r in ways[w]]
    budget = max(1, o.budget, len(slots))
    goal = min(budget, max(1, o.papers if several else 1))
    taken, pages, report = [], collections.Counter(), {}
    where = lambda i: (packages[i]["paper_id"], packages[i]["page"])

    def take(i, force=False):
        if i in taken or len(taken) >= budget or (not force and pages[where(i)] >= max(1, o.page_cap)):
            return False
        taken.append(i)
        pages[where(i)] += 1
        return True

    for w, x, r in slots:
        report[f"{w}:{x}"] = "served" if (w != "fallback_slot" and set(r) & set(taken)) or any(take(i) for i in r) else "not served"
    for k in asked:
        own = [i for i in order if packages[i]["kind"] == k]
        if own:
            take(own[0])
    for w in ("claim", "paper_claim", "paper_local"):
        for _, r in ways[w]:
            take(r[0])
    if several:
        first = {}
        for i in order:
            first.setdefault(packages[i]["paper_id"], i)
        for i in list(first.values())[:goal]:
            take(i)
        for paper in sorted({packages[i]["paper_id"] for i in taken}):
            for k in asked:
                own = [i for i in order if packages[i]["paper_id"] == paper and packages[i]["kind"] == k]
                for i in [i for i in own if packages[i]["section_type"] == "method"][:1] * ("method" in query) + own[: max(1, o.per_modality)]:
                    take(i)
            for i in [i for i in order if packages[i]["paper_id"] == paper and packages[i]["kind"] == "text_span"][: o.supporting]:
                take(i)
    if o.page_anchors:
        by_page = collections.defaultdict(list)
        for i in order:
            if packages[i]["kind"] == "text_span":
                by_page[where(i)].append(i)
        for page in sorted(by_page):
            for i in by_page[page][: o.page_anchors]:
                take(i, True)
    have, papers = {packages[i]["kind"] for i in taken}, {packages[i]["paper_id"] for i in taken}
    while len(taken) < budget:
        open_ = [i for i in order if i not in taken and pages[where(i)] < max(1, o.page_cap)]
        if not open_:
            break
        gain = lambda i: (packages[i]["kind"] in asked and packages[i]["kind"] not in have) + (several and len(papers) < goal and packages[i]["paper_id"] not in papers)  # noqa: B023, E731
        best = max(open_, key=gain)
        if o.adaptive and len(taken) >= min(budget, max(1, o.least)) and set(asked) <= have and (not several or len(papers) >= goal) and not gain(best):
            break
        take(best)
        have.add(packages[best]["kind"])
        papers.add(packages[best]["paper_id"])
    return [packages[i]["package_id"] for i in taken], report


@pytest.mark.parametrize("options", [P.PackageOptions(), P.PackageOptions(budget=6, least=2, papers=3, page_cap=1, supporting=1), P.PackageOptions(budget=9, papers=2, page_anchors=1, pool=5, adaptive=False), P.PackageOptions(budget=3, least=1, per_modality=1)])
def test_selection_against_a_plain_loop(spark, options):
    rng = random.Random(repr(options))
    vocabulary = [f"w{i}" for i in range(25)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=range(1, 26), k=n))
    questions, packages, routes = [], [], []
    for q in (f"q{i:02}" for i in range(12)):
        kinds = rng.choice([None, [], ["table"], ["figure", "table"], ["text_span", "equation_algorithm"]])
        questions.append((q, text(4) + rng.choice(["", " method"]), None, kinds, rng.random() < 0.5))
        for at in range(rng.randint(1, 60)):
            kind = rng.choice(L.OFFICIAL_TYPES)
            packages.append(pack(f"{q}-{at}", at, kind, rng.choice("abcd"), rng.randint(1, 4), text(rng.randint(0, 12)), rng.choice([None, "", "Table x"]), rng.choice([None, round(rng.random(), 1)]), rng.choice([None, rng.random()]), None, rng.choice([None, "method"]), q))
        for way in ("claim", "claim", "slot", "slot", "fallback_slot", "fallback_slot", "slot_paper", "paper_claim", "paper_local"):
            if rng.random() < 0.6:
                own = way.startswith("slot_p") or way.startswith("paper")
                routes.append((q, way, len(routes), text(3), rng.choice([None, ["table"], ["figure", "citation_context"]]) if "slot" in way else None, rng.choice("abcd") if own else None))
    got = collections.defaultdict(list)
    for r in P.select_packages(spark.createDataFrame(questions, QUESTION), spark.createDataFrame(packages, PACKAGE), spark.createDataFrame(routes, ROUTE), options).collect():
        got[r["query_id"]].append(r)
    names = PACKAGE.replace(" string", "").replace(" long", "").replace(" double", "").replace(" array<string>", "").split(", ")
    for question in questions:
        own = [dict(zip(names, p, strict=True)) for p in packages if p[0] == question[0]]
        taken, report = plain(question, own, [r[1:] for r in routes if r[0] == question[0]], options)
        rows = got[question[0]]
        assert [r["name"] for r in sorted((r for r in rows if r["entry"] == "package"), key=lambda r: r["place"])] == taken, question
        assert {r["name"]: r["detail"] for r in rows if r["entry"] == "slot"} == report, question
