"""Hybrid retrieval and unit scores against plain Python on small tables."""

import collections
import math
import re

import pytest

from evidentia.functions import text as T
from evidentia.operators import hybrid

TOKEN = re.compile("[a-z0-9]+")
STOP = set(T.STOPWORDS)


def tokens(text):
    return TOKEN.findall((text or "").lower())


def compact(text):
    return re.sub("[^a-z0-9]+", "", (text or "").lower())


def aliases_of(title, abstract):
    words = [w for w in tokens(title) if len(w) > 1 and w not in STOP]
    out = set()
    if len(words) >= 2:
        out |= {"".join(w[0] for w in words)} | {"".join(w[0] for w in words[i : i + n]) for n in range(2, 7) for i in range(len(words) - n + 1)}
    named = lambda x: {compact(m) for m in re.findall(T.METHOD, x) if 2 <= len(m) <= 30}
    return {a for a in out | named(title) | named(abstract[:1600]) if 2 <= len(a) <= 30}


def bm25(docs, query):
    n, total = len(docs), sum(map(len, docs))
    df = collections.Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        tf = collections.Counter(d)
        norm = 1.5 * (0.25 + 0.75 * max(1, len(d)) / max(total / n, 1e-9))
        out.append(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + norm) for t in query if tf[t]))
    return out


PAPERS = [
    (1, "BERT-X: Deep Nets for Vision", "We train CLIP2 models on images. RoBERTa is used.", "ICML", "2021"),
    (2, "A Survey of Graph Methods", "Graph methods and the bertx model are many.", "ACL", "2021"),
    (3, "Deep Nets for Vision", "", "ICML", "2020"),
    (4, "", "words only about nets", "CVPR", "2022"),
    (5, "Sparse Attention Is Fast", "Attention with FlashAttn kernels in many nets.", None, None),
]
QUESTIONS = [(1, "Which ICML 2021 paper uses BERT-X and CLIP2 nets?"), (2, "What does 'Deep Nets for Vision' say?"), (3, "graph methods across all venues at ACL"), (4, "")]


def test_hybrid_scores(spark):
    got = collections.defaultdict(dict)
    papers = spark.createDataFrame(PAPERS, "paper_id long, title string, abstract string, venue string, year string")
    questions = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    terms_of = {r["query_id"]: r["t"] for r in questions.select("query_id", T.query_terms(questions["question"]).alias("t")).collect()}
    for r in hybrid.hybrid_scores(papers, questions, 10).collect():
        got[r["query_id"]][r["paper_id"]] = (r["score"], r["rank"])
    al = [sorted(aliases_of(t, a)) for _, t, a, _, _ in PAPERS]
    full = [" ".join(x for x in (t, a, v, y) if x is not None) for _, t, a, v, y in PAPERS]
    corpora = [[tokens(p[1]) + al[k] * 3 for k, p in enumerate(PAPERS)], [tokens(p[2]) for p in PAPERS], [tokens(full[k]) + al[k] * 2 for k in range(len(PAPERS))], [al[k] or ["noalias"] for k in range(len(PAPERS))]]
    weights = (3.2, 1.0, 0.8, 4.5)
    df = collections.Counter(a for own in al for a in own)
    for q, text in QUESTIONS:
        own, terms = tokens(text), terms_of[q]
        parts = [bm25(c, (terms or own) if k == 3 else own) for k, c in enumerate(corpora)]
        venues = {v for v in T.VENUES if re.search(rf"(?i)\b{v}\b", text)}
        years = set(re.findall(r"\b(20\d\d)\b", text))
        want = {}
        for k, (paper, title, abstract, venue, year) in enumerate(PAPERS):
            hits = [t for t in terms if t in al[k]]
            if not any(p[k] for p in parts) and not hits:
                continue
            s = sum(w * p[k] for w, p in zip(weights, parts, strict=True))
            s += sum(4.0 if len(t) <= 3 and df[t] > 80 else max(10 if len(t) <= 3 else 18, (75 if len(t) <= 3 else 95) / math.sqrt(df[t])) for t in hits)
            for t in terms:
                s += 90 if len(t) >= 4 and t in compact(title) else 30 if len(t) >= 5 and t in compact(abstract[:2400]) else 18 if len(t) >= 5 and t in compact(full[k]) else 0
            s += 120 if len(compact(title)) >= 12 and compact(title) in compact(text) else 0
            s += (0 if not venues else 12 if venue in venues else 0 if "across all venues" in text.lower() else -8) + (0 if not years else 6 if year in years else -4)
            want[paper] = s
        assert {p: s for p, (s, _) in got[q].items()} == pytest.approx(want, abs=1e-5), q
        assert sorted(got[q], key=lambda p: got[q][p][1]) == sorted(want, key=lambda p: (-round(want[p], 6), p))


def test_unit_scores(spark):
    units = [(1, 1, "text_span", "Deep results", "the bertx of table 2 is deep"), (1, 2, "table", "", "Table 2 accuracy\n| a | b |"), (1, 3, "table", "Other", "nothing\naccuracy"), (2, 1, "text_span", None, ""), (1, 4, "figure", "Accuracy", None)]
    questions = [(1, "What accuracy has BERT-X in Table 2?"), (2, "deep")]
    got = {(r["query_id"], r["unit_id"]): r["score"] for r in hybrid.unit_scores(spark.createDataFrame(units, "query_id long, unit_id long, unit_type string, section_title string, text string"), spark.createDataFrame(questions, "query_id long, question string")).collect()}
    for q, text in questions:
        own = [u for u in units if u[0] == q]
        scores = bm25([tokens(u[4]) for u in own], tokens(text))
        for u, s in zip(own, scores, strict=True):
            low = (u[4] or "").lower()
            s += 3 * ("bertx" in low and q == 1) + 2 * bool(set(tokens(u[3])) & set(tokens(text))) + 4 * ("table 2" in low and q == 1)
            s += 2 * (u[2] != "text_span" and bool(set(tokens(low.split("\n")[0])) & set(tokens(text))))
            assert got[q, u[1]] == pytest.approx(s, abs=1e-5), u


def test_output_lock_and_replay(spark, tmp_path):
    from evidentia.sources.jsonl import output_lock, replay, write_stage

    with output_lock(spark, str(tmp_path)), pytest.raises(RuntimeError, match="already in use"), output_lock(spark, str(tmp_path)):
        pass
    with output_lock(spark, str(tmp_path)):
        write_stage(spark.range(5), str(tmp_path / "raw"), {"k": 1})
    again = replay(spark, str(tmp_path / "raw"), str(tmp_path / "next"), {"k": 2}, lambda df: df.where("id % 2 = 0"))
    assert sorted(r["id"] for r in again.collect()) == [0, 2, 4]


def test_find_file(tmp_path):
    from evidentia.sources.jsonl import find_file

    (tmp_path / "data").mkdir()
    for name in ("data/a.jsonl", "a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text("")
    assert find_file(str(tmp_path), "a.jsonl") == str(tmp_path / "data/a.jsonl") and find_file(str(tmp_path), "b.jsonl") == str(tmp_path / "b.jsonl")
    with pytest.raises(FileNotFoundError):
        find_file(str(tmp_path), "c.jsonl")
