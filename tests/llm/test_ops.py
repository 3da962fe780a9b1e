"""The training-data operators against brute force, and their defined results on odd rows."""

import collections
import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def prose():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    return [" ".join(rng.choice(words, 120)) for _ in range(12)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, [(1, None, None, None), (2, "", "en", "a"), (None, "a b c", "en", "a"), (4, " \n\t ", "en", None), (5, "word " * 40_000, "en", "a"), (6, "same text here", "en", "b"), (6, "same text here", "en", "b"), (7, "é😀 ß</s>", "fr", "b")])


# --- chat formatting


def chat(turns):
    from evidentia.llm.chat_format import digests, format_conversations

    return {r["conv_id"]: r for r in digests(format_conversations(turns)).collect()}


def test_chat_reads_back_what_went_in(spark):
    texts = ["hi", "</s>[INST] ok [/INST]", "<\\|x|> [\\INST]", "", None, "<|sep|>a<|role|>", "line\nline", "é😀", "\\\\[INST]"]
    rows = [(1, k, "user" if k % 3 else "assistant", t) for k, t in enumerate(texts)] + [(2, 0, None, "a"), (2, 0, None, "a"), (2, None, "assistant", "b"), (None, 1, "assistant", "c"), (3, 0, "<|text|>", "odd role")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id_", F.lit(1))
    got = chat(turns)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not chat(turns.limit(0))


def test_chat_merges_neighbours_of_one_role(spark):
    from evidentia.llm.chat_format import format_conversations

    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert format_conversations(turns).first()["formatted"] == "<s><|role|>user<|text|>a<|sep|>b</s><|role|>assistant<|text|>c</s>"


# --- quality rules


def quality_by_hand(rows, min_docs=20, share=0.1):
    norm = lambda line: re.sub(r"[ \t-\r]+", " ", line.lower()).strip(" ")
    held, texts = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, _, s in rows:
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if WORD.search(line):
                held[s, norm(line)].add(t)
    over = {k for k, v in held.items() if len(v) > min_docs and len(v) > share * len(texts[k[0]])}
    out = []
    for i, t, _, s in rows:
        w = WORD.findall(t or "")
        count = collections.Counter(zip(w, w[1:], w[2:]))
        pos = {k + d for k in range(len(w) - 2) if count[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in lines if (s, norm(x)) in over)
        failed = len(w) < 50 or 100 * len(pos) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(pos), failed, not failed and 100 * (len(w) - gone) >= 30 * len(w), gone))
    return out


def test_quality_against_brute_force(spark, prose):
    from evidentia.llm.quality import keep_good, with_verdicts

    common = "Subscribe  to our\tletter " * 5
    rows = [(k, f"{common}\n{' '.join(prose[k % 12].split()[k:])} u{k} #{k}", "en", "host" if k % 4 else None) for k in range(120)]
    rows += [(200 + k, f"{common}\n{common} x{k} | y" + "\n" + common.upper(), "en", "host") for k in range(30)] + [(300, None, None, None), (301, "a b " * 100, "en", "host"), (302, " ".join(prose[:3]), "en", "h2"), (302, " ".join(prose[:3]), "en", "h2"), (None, "", "en", "host")]
    got = with_verdicts(docs_of(spark, rows)).select("doc_id", "quality.*").drop("clean_text").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(quality_by_hand(rows), key=key)
    kept = keep_good(docs_of(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(found) == {r[0] for r in quality_by_hand(rows) if r[7]}
    assert not any("Subscribe" in t for i, t in found.items() if i < 120 and i % 4)


def test_quality_beyond_the_broadcast(spark, prose, monkeypatch):
    from evidentia.llm import quality

    rows = [(k, f"Read {k % 3} more of our news here\n{prose[k % 12]} u{k}", "en", "host" if k % 5 else None) for k in range(300)]
    docs = docs_of(spark, rows)
    want = sorted(map(str, quality.with_verdicts(docs).select("doc_id", "quality").collect()))
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert sorted(map(str, quality.with_verdicts(docs).select("doc_id", "quality").collect())) == want
    assert any("removed_words=0" not in x for x in want)


def test_quality_on_odd_rows(spark, odd):
    from evidentia.llm.quality import with_verdicts

    assert with_verdicts(odd).where("quality.kept").count() == 0
    assert with_verdicts(odd.limit(0)).count() == 0


# --- mixing


def cheapest(patterns, routes, quotas):
    """Most tokens that can flow, and the least cost of that, over all ways to fill the routes."""
    keys = sorted(routes)

    def cost(flow):
        return sum(sum(2 * (k // patterns[p]) + 1 for k in range(sum(v for (q, _), v in flow.items() if q == p))) for p in patterns)

    found = (0, 0)
    for amounts in itertools.product(*(range(routes[k] + 1) for k in keys)):
        flow = dict(zip(keys, amounts, strict=True))
        if all(sum(v for (_, s), v in flow.items() if s == t) <= quotas[t] for t in quotas):
            found = max(found, (sum(amounts), -cost(flow)))
    return found, cost


def test_flow_is_the_cheapest():
    from evidentia.llm.mixing import min_cost_flow

    rng = np.random.default_rng(6)
    for _ in range(40):
        names = [("a",), ("b",), ("a", "b"), ("a", "b", "c")]
        chosen = [names[k] for k in sorted(rng.choice(4, int(rng.integers(1, 4)), replace=False))]
        patterns = {p: int(rng.integers(1, 3)) for p in chosen}
        routes = {(p, s): int(patterns[p] * rng.integers(1, 3)) for p in chosen for s in p}
        quotas = {s: int(rng.integers(0, 5)) for s in "abc"}
        (most, least), cost = cheapest(patterns, routes, quotas)
        flow = min_cost_flow(patterns, routes, quotas)
        assert all(0 <= v <= routes[k] for k, v in flow.items())
        assert all(sum(v for (_, s), v in flow.items() if s == t) <= quotas[t] for t in quotas)
        assert (sum(flow.values()), -cost(flow)) == (most, least), (patterns, routes, quotas, flow)
    assert min_cost_flow({}, {}, {}) == {} and min_cost_flow({("a",): 0}, {(("a",), "a"): 0}, {"a": 5}) == {}


def shares(sizes, weights, copies=3):
    """Targets in plain Python: what is left is shared by weight until no source gets more than its copies."""
    out, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        heavy = sum(weights[s] for s in open_)
        full = {s for s in open_ if copies * sizes[s] <= left * weights[s] / heavy}
        if not full:
            return out | {s: left * weights[s] / heavy for s in open_}
        out |= {s: copies * sizes[s] for s in full}
        left -= sum(copies * sizes[s] for s in full)
        open_ -= full
    return out


def test_source_targets(spark):
    from evidentia.llm.mixing import source_targets

    rng = np.random.default_rng(9)
    sizes = {f"s{k:02}": int(rng.integers(0, 10) ** 3) for k in range(30)} | {None: 500}
    docs = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n long")
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = shares(sizes, {s: k % 3 + 1 for k, s in enumerate(names)})
    for part_rows in (1_000_000, 4):  # one range of sources, and many
        got = {r["source"]: r for r in source_targets(docs, size=F.col("n"), part_rows=part_rows).collect()}
        assert {s: r["size"] for s, r in got.items()} == sizes
        assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)
    assert source_targets(docs.limit(0), size=F.col("n")).count() == 0


def test_mix_meets_targets(spark, prose):
    from evidentia.llm.mixing import memberships, mix, source_targets, take_mix

    rows = [(k, " ".join(prose[k % 12].split()[: 5 + k % 90]) + (f" u{k}" if k % 3 else ""), "en", ["a", "b", "c", None][k % 7 % 4]) for k in range(600)] + [(None, None, None, "a"), (9000, "", "en", "z")]
    docs = docs_of(spark, rows)
    quotas = source_targets(docs)
    assert sum(r["size"] for r in quotas.collect()) == sum(len(WORD.findall(r[1] or "")) for r in rows)
    held = collections.defaultdict(list)
    for r in rows:
        held[r[1] or ""].append(r[3] or "\x00")
    joined = memberships(docs).select("doc_id", "text", "_members", "_times").collect()
    assert len(joined) == len(rows)
    for r in joined:
        own = held[r["text"] or ""]
        assert set(r["_members"]) == set(own) and (r["_times"] == len(own) or len(set(own)) == 1)

    def mixed(d):
        d = memberships(d).withColumn("w", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), lambda x: x != "")))
        return mix(d, F.col("_members"), quotas.select("source", F.col("target").alias("quota")), own=F.col("source"), size=F.col("w"), once=F.col("w") / F.col("_times")).collect()

    got, taken = mixed(docs), collections.Counter()
    assert len(got) == len(rows) and any(len(r["_pattern"]) > 1 for r in got)
    for r in got:
        assert 0 <= r["_copies"] <= 3
        taken[r["source"]] += r["_copies"] * r["_size"]
    for r in quotas.collect():
        assert abs(taken[r["source"]] - r["target"]) <= 100, r
    again = sorted((r["doc_id"] or -1, r["_copies"]) for r in mixed(docs.repartition(7)))
    assert again == sorted((r["doc_id"] or -1, r["_copies"]) for r in got)
    assert take_mix(docs).columns == docs.columns
    assert take_mix(docs.limit(0)).count() == 0


def test_mix_of_any_source(spark):
    """Without an own source, a document counts for whichever of its sources the flow sends it to."""
    from evidentia.llm.mixing import mix

    rows = [(k, ["a"] if k < 100 else ["a", "b"]) for k in range(200)]
    quotas = spark.createDataFrame([("a", 150.0), ("b", 30.0)], "source string, quota double")
    got = mix(spark.createDataFrame(rows, "doc_id long, s array<string>"), F.col("s"), quotas, size=F.lit(1)).collect()
    taken = collections.Counter(len(r["_pattern"]) for r in got for _ in range(r["_copies"]))
    assert sum(taken.values()) == 180 and taken[2] >= 80 and max(r["_copies"] for r in got) == 1


def test_mix_takes_a_part_of_equal_rows(spark):
    from evidentia.llm.mixing import take_mix

    rows = [(1, "one two three four five six seven eight nine ten", "en", "a")] * 300 + [(k + 1000, f"{k} two three four five six seven eight nine ten", "en", "b") for k in range(300)]
    rows += [(None, f"n{k} two", "en", "c") for k in range(100)]
    taken = collections.Counter()
    for r in take_mix(docs_of(spark, rows)).collect():
        taken[r["source"]] += len(r["text"].split())
    want = shares({"a": 3000, "b": 3000, "c": 200}, {"a": 1, "b": 2, "c": 3})
    assert all(abs(taken[s] - want[s]) <= 5 for s in want), (taken, want)


# --- licences


def test_license_scan_is_its_model(spark):
    from evidentia.llm.license_scan import OTHER, TEMPLATES, classify, scan

    lines = [t for texts in TEMPLATES.values() for t in texts] + OTHER + ["", "Licensed under the Foo License", "released under the mit license.", "the license", "zz yy"]
    docs = docs_of(spark, [(1, "\n".join(lines), "en", "a"), (2, None, None, None), (3, "", None, None), (1, lines[0], "en", "a")])
    got = {(r["doc_id"], r["position"], r["family"]) for r in scan(docs).collect()}
    want = {(1, k, classify(x)) for k, x in enumerate(lines) if classify(x) != "unknown"} | {(1, 0, classify(lines[0]))}
    assert got == want
    for family, texts in TEMPLATES.items():
        assert sum(classify(t) == family for t in texts) >= len(texts) - 1, family
    assert not any(classify(t) != "unknown" for t in OTHER)
    assert scan(docs.limit(0)).count() == 0


def test_telling_words_lose_nothing():
    """A paragraph without any telling word shares less than half of every template, and holds no heading."""
    from evidentia.llm import license_scan as L

    strong = set(L.telling(0.5))
    for texts in L.TEMPLATES.values():
        for t in texts:
            features = L._features(L._words(t))
            left = [f for f in features if not strong & set(f.split())]
            assert len(left) / len(features) < 0.5
    assert all(strong & set(L._words(t)) for texts in L.NAMES.values() for t in texts)


def test_wrapped_licenses(spark):
    import textwrap

    from evidentia.llm.license_scan import NAMES, TEMPLATES, classify, scan

    mit = ["MIT License", "Copyright (c) 2020 Some Body", TEMPLATES["MIT"][-1] + "."]
    text = "\n\n".join("\n".join(textwrap.wrap(x, 70)) for x in mit)
    gpl = "\n".join(textwrap.wrap(TEMPLATES["GPL"][2], 40))
    docs = docs_of(spark, [(1, text, "en", "a"), (2, f"Plain words.\r\n \r\n{gpl}\n\nmore words", "en", "a"), (3, "words\nReleased under the MIT License.\nwords", "en", "a")])
    got = {(r["doc_id"], r["position"], r["family"]): r["paragraph"] for r in scan(docs).collect()}
    assert set(got) == {(1, 0, "MIT"), (1, 4, "MIT"), (2, 2, "GPL"), (3, 1, "MIT")}
    assert got[1, 4, "MIT"] == mit[-1] and got[2, 2, "GPL"] == TEMPLATES["GPL"][2]
    assert {family: [classify(x) for x in own] for family, own in NAMES.items()} == {family: [family] * len(own) for family, own in NAMES.items()}
    lgpl = "\n".join(textwrap.wrap(TEMPLATES["LGPL"][2], 60))
    more = docs_of(spark, [(1, lgpl, "en", "a"), (2, "GNU Affero General Public License\nVersion 3", "en", "a"), (3, "\n".join(textwrap.wrap(TEMPLATES["ISC"][1], 72)) * 1, "en", "a")]).withColumn("family", F.lit("x")).withColumn("p", F.lit("y"))
    assert {(r["doc_id"], r["family"]) for r in scan(more).collect()} == {(1, "LGPL"), (2, "AGPL"), (3, "ISC")}
    strange = [
        "Licensed under the European Union Public Licence, version 1.2 or later",
        "This program is made available under the terms of the Server Side Public License, version 1.",
        "Licensed under the Open Software License version 3.0",
        "This work is licensed under the Common Development and Distribution License",
        "You may only use this file under the Microsoft Reciprocal License",
        "The contents of this file are subject to the Common Public Attribution License Version 1.0",
    ]
    assert [classify(x) for x in strange] == ["unknown"] * len(strange)
    assert classify("He asked for the license of the MIT driver and was told to read the public form") == "unknown"


# --- toxicity


def test_toxicity_learns_and_scores_clauses(spark, prose):
    from evidentia.llm.toxicity import Grammar, fit, keep_harmless, score

    rng = np.random.default_rng(8)
    said = lambda: " ".join(rng.choice(" ".join(prose).split(), 60))
    rows = [(k, f"{said()}. You {['grobian', 'lumpenwort', 'lumpenfisch', 'dolt'][k // 3 % 4] if k % 3 == 0 else 'friend'}! {said()}") for k in range(240)]
    sample = spark.createDataFrame([(t, int(k % 3 == 0)) for k, t in rows], "text string, toxic int")
    grammar = fit(sample)
    assert set(grammar.words) >= {"grobian", "dolt"} and grammar.insult("lumpenhund") > 0
    docs = docs_of(spark, [(1, "well, you dolt.", "en", "a"), (2, prose[0], "en", "a"), (3, None, None, None), (4, "", "en", "a")])
    got = {r["doc_id"]: r for r in score(docs, grammar).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == got[3]["predicted"] == got[4]["predicted"] == 0
    assert sorted(r["doc_id"] for r in keep_harmless(docs, grammar).collect()) == [2, 3, 4]
    g = Grammar(words={"dolt": 1.0})
    assert g.matches("he said the dolt left")[3] == 1.0 and g.matches("not a dolt")[2] == 1.0 and g.matches("you are a dolt")[1] == 1.0 and g.matches("dolt")[0] == 1.0
    assert g.matches("I will kill you")[4] == 1.0 and g.matches("kill the light")[4] == 0.0
    assert g.matches("she beat them in chess") == [0.0] * 5 and g.matches("we will burn the wood. you see?") == [0.0] * 5
    assert [g.matches(t)[4] for t in ("Ich werde dich töten", "je vais te tuer", "te mataré", "he said he will kill you", "I will not kill you")] == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert g.matches("nobody is a dolt here")[2] == 1.0 and g.matches('"dolt", he said. dolt')[3] == 1.0
    assert fit(sample.limit(0)).words == {}
    assert {r["score"] for r in score(docs.limit(0), grammar).collect()} == set()
    twice = docs_of(spark, [(7, "you dolt " * 30_000, "en", "a"), (7, "you dolt " * 30_000, "en", "a"), (8, prose[1], None, None), (8, prose[1], None, None)])
    got = sorted((r["doc_id"], r["predicted"]) for r in score(twice, grammar).collect())
    assert got == [(7, 1), (7, 1), (8, 0), (8, 0)]


def by_hand(symbols):
    """The matches of symbols, clause by clause, in plain Python."""
    found, quoted, clause = [0.0] * 5, False, []
    for x in symbols:
        clause.append(x)
        if x not in ("end", "line"):
            continue
        aimed, meant, reach, said = "target" in clause, "intention" in clause, 0, False
        for y in clause:
            if y == "quote":
                quoted, said = not quoted, said or quoted
            elif y == "report":
                said = said or not quoted
            elif y == "insult":
                found[2 if reach else 3 if quoted or said else 1 if aimed else 0] += 1
            elif y in ("threat", "future") and not reach and aimed and (meant or y == "future"):
                found[3 if quoted or said else 4] += 1
            reach = 3 if y == "negation" else max(0, reach - 1)
        quoted, clause = quoted and x != "line", []
    return found


def test_machine_against_all_paths():
    """The composed machine against every path through the cascade, one transducer after the other, and against plain clauses."""
    from evidentia.llm.toxicity import MATCHES, SYMBOLS, cascade, run

    rng = np.random.default_rng(12)
    for _ in range(400):
        symbols = [*(str(x) for x in rng.choice(SYMBOLS, int(rng.integers(0, 9)))), str(rng.choice(["end", "line"]))]
        ways = [(symbols, 1.0)]
        for t in cascade((2.0, 3.0, 5.0, 7.0, 11.0)):
            ways = [(out, w * v) for s, w in ways for out, v in t.paths(s)]
        found = {tuple(out.count(m) for m in MATCHES) for out, _ in ways}
        assert len(found) == 1, symbols
        assert list(found.pop()) == run((x, 1.0) for x in symbols) == by_hand(symbols), symbols
        for out, w in ways:
            assert w == pytest.approx(np.prod([(2.0, 3.0, 5.0, 7.0, 11.0)[MATCHES.index(m)] for m in out if m]))


def test_toxicity_sees_held_out_labels(spark):
    """Held-out accuracy on the given tables: nearly every labelled document is judged right."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").toPandas()
    assert len(got) > 30 and (got["predicted"] == got["toxic"]).mean() >= 0.97


# --- near copies


def brute_classes(texts, least=0.8):
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None for w in (WORD.findall(t or "") for t in texts)]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both >= least * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                    root[find(a)] = find(b)
    return [find(k) for k in range(len(texts))]


def test_near_classes_against_brute_force(spark, prose):
    from evidentia.llm.near_dedup import keep_one, near_classes

    rng = np.random.default_rng(5)
    texts = []
    for p in prose[:8]:
        texts.append(p)
        for _ in range(6):
            w = p.split()
            for at in rng.integers(0, len(w), int(rng.integers(1, 7))):
                w[at] = f"e{rng.integers(10**6)}"
            texts.append(" ".join(w))
    texts += [prose[9], prose[9], "a b", "a b", "a  b", "one two three", None, "", " ", "x " * 300, "x " * 301, "x " * 200]
    got = {r["doc_id"]: r["class_id"] for r in near_classes(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    groups = lambda ids: {frozenset(k for k in range(len(texts)) if ids[k] == c) for c in set(ids)}
    assert groups([got[k] for k in range(len(texts))]) == groups(brute_classes(texts))
    assert all(got[k] == min(j for j in range(len(texts)) if got[j] == got[k]) for k in got)
    docs = docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)] + [(0, texts[0], "en", "a"), (None, prose[10], None, None)])
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == sorted(set(got.values()))


def test_near_classes_links_beyond_leaders(spark):
    """Many texts around one passage: those links that no leader finds come from the shared-element search."""
    from evidentia.llm.near_dedup import near_classes

    rng = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*(f"r{rng.integers(10**7)}" for _ in range(int(n))), *passage]) for n in rng.integers(2, 30, 90)]
    got = [r["class_id"] for r in near_classes(docs_of(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).orderBy("doc_id").collect()]
    want = brute_classes(texts)
    groups = lambda ids: {frozenset(k for k in range(len(texts)) if ids[k] == c) for c in set(ids)}
    assert groups(got) == groups(want)


def test_near_classes_empty(spark, odd):
    from evidentia.llm.near_dedup import near_classes

    assert near_classes(odd.limit(0)).count() == 0
    assert near_classes(odd).count() == odd.count()


def test_bag_minhash_estimates_weighted_jaccard():
    from evidentia.llm.near_dedup import bag_minhash, overlap

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**62, 300).astype(np.uint64)
    a = np.concatenate([a, np.repeat(a[:20], 9)])
    b = a.copy()
    b[:80] = rng.integers(0, 2**62, 80).astype(np.uint64)
    a, b = np.sort(a), np.sort(b)
    s = bag_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 4096)
    assert abs((s[0] == s[1]).mean() - overlap(a, b)) < 0.03


# --- archive


def test_warc_round_trip(spark, tmp_path):
    from evidentia.llm.warc import read_archive, write_archive

    big, rows = "ü" * 700, []
    rows = [(1, "http://a/", big), (3, "http://b/\r\nX: y", big), (2, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "http://e", None), (7, "http://f", ""), (3, "http://b2", big), (None, "http://n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k"))
    write_archive(pages, str(tmp_path / "w"))
    got = read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) == len({r["record_id"] for r in got})
    for r in got:
        same = [x for x in rows if x[0] == r["page_id"]][0][2] or ""
        raw = same.encode()
        assert (r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) == (len(raw), hashlib.sha1(raw).hexdigest(), raw)
        revisit = same == big and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body == (b"" if revisit else raw) + b"\r\n\r\n"
        assert head.count(b"\r\n") == r["header"].count("\r\n") - 1 and f"Content-Length: {0 if revisit else len(raw)}".encode() in head
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    write_archive(pages.limit(0), str(tmp_path / "e"))
    assert read_archive(spark, str(tmp_path / "e")).count() == 0


def test_warc_slices_common_payloads(spark, tmp_path, monkeypatch):
    from evidentia.llm import warc

    monkeypatch.setattr(warc, "SLICE_RECORDS", 7)
    long = "é" * 400_000
    rows = [(k, "http://a/", "same page " * 200) for k in range(60)] + [(100 + k, None, "") for k in range(30)] + [(200, "http://l", long), (201, "http://l", long)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    stored = {r["slices"] for r in spark.read.parquet(str(tmp_path / "w/payloads")).collect()}
    assert stored == {9, 5, 1}
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        top = 59 if k < 60 else 201 if k >= 200 else None
        assert bytes(got[k]["payload"]) == html.encode() and got[k]["refers_to"] == (top if top is not None and k != top else None)


def test_warc_notices_damage(spark, tmp_path):
    from evidentia.llm import warc

    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 2000)], "page_id long, url string, html string"), str(tmp_path / "w"))
    rows = warc.records(spark, str(tmp_path / "w"))
    short = rows.withColumn("record", F.expr("substring(record, 1, length(record) - 1)"))
    changed = rows.withColumn("record", F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit(b"y\r\n\r\n")))
    for bad in (short, changed):
        with pytest.raises(Exception, match="broken record|no payload"):
            warc.parsed(bad).select("payload_digest").collect()


# --- nearest neighbours


def test_nearest_against_brute_force(spark):
    from evidentia.llm.ann_forest import nearest

    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2.0, (1500, 1))
    x[700:760] = x[700]
    rows = [(k, [float(v) for v in np.float32(r)]) for k, r in enumerate(x)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 24), (2060, [float("nan")] * 24), (2080, [None] * 24), (None, rows[0][1]), (2100, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + bad + rows[:3], "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = collections.defaultdict(list)
    for r in nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=500).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    full = np.float32(x).astype(float)
    found = []
    for q, own in got.items():
        s = full @ full[q]
        order = [k for k in np.lexsort((np.arange(1500), -s)) if k != q][:20]
        assert len(own) == 20 and all(abs(v - s[k]) < 1e-9 for k, v in own) and [v for _, v in own] == sorted((v for _, v in own), reverse=True)
        found.append(len(set(order) & {k for k, _ in own}) / 20)
    assert np.mean(found) >= 0.9
    assert nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_nearest_of_every_dimension(spark):
    from evidentia.llm.ann_forest import nearest

    vectors = spark.range(2 * 4_150).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.expr("int(id div 2)")), lambda i: F.when(i == 0, 1.0).otherwise(0.0)).alias("embedding"))
    vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = {(r["query_id"], r["vec_id"]) for r in nearest(vectors, vectors.where("vec_id % 2 = 0"), trees=1).collect()}
    assert got == {(k, k + 1) for k in range(0, 2 * 4_150, 2)}


# --- languages


def test_language_models(spark):
    from evidentia.llm.langid import fit, identify

    rng = np.random.default_rng(4)
    parts = {"aa": ["ta", "ko", "mi", "ra"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["ção", "lh", "que", "ois"]}
    word = lambda p: "".join(rng.choice(parts[p], 3))
    text = lambda p: " ".join(word(p) for _ in range(40))
    train = spark.createDataFrame([(text(p), p) for p in parts for _ in range(40)] + [("x y", None), (None, "aa")], "text string, lang string")
    model = fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    docs = docs_of(spark, [(k, text(p), None, None) for k, p in enumerate(["aa", "bb", "cc"] * 10)] + [(100, None, None, None), (101, "12 34 !", None, None), (102, "", None, None)])
    got = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert all(got[k]["lang_pred"] == ["aa", "bb", "cc"][k % 3] for k in range(30))
    assert all(got[k]["lang_pred"] == "und" for k in (100, 101, 102)) and all(0 <= r["score"] <= 1 for r in got.values())
    strange = docs_of(spark, [(1, "zxzxqj vvwwxx qqzzjj " * 20, None, None)])
    assert identify(strange, model, reject=True).first()["lang_pred"] == "und"
    assert {r["lang_pred"] for r in identify(docs, fit(train.limit(0))).collect()} == {"und"}


def test_every_language_and_gram_is_learned(spark):
    from evidentia.llm.langid import KneserNey, codes, fit, grams, identify, _own

    own = lambda k: "".join(chr(0xAC00 + 7 * k + j) for j in range(3))
    texts = {f"l{k:03}": [f"{own(k)} {own(k)[::-1]} ab", f"{own(k)} once{k % 7 * 'x'}"] for k in range(205)}
    texts["l000"] += ["hot letters of one language " * 50] * 3
    train = spark.createDataFrame([(t, x) for x, own in texts.items() for t in own], "text string, lang string")
    model = fit(train, file_rows=5_000)
    assert model.languages == sorted(texts)
    docs = docs_of(spark, [(k, own(k), None, None) for k in range(205)])
    assert {r["doc_id"]: r["lang_pred"] for r in identify(docs, model).collect()} == {k: f"l{k:03}" for k in range(205)}
    every, bounds = codes([t for own in texts.values() for t in own])
    asked = np.unique(grams(every)[_own(bounds)])
    for at in (0, 7, 204):
        code, bounds = codes(texts[f"l{at:03}"])
        gram, n = np.unique(grams(code)[_own(bounds)], return_counts=True)
        plain = KneserNey(gram, n, len(np.unique(asked & np.uint64(0xFFFF))))
        assert np.allclose(model.models[at].surprise(asked), plain.surprise(asked), rtol=1e-12)


def test_language_calibration_is_over_all_rows(spark):
    from evidentia.llm.langid import SHARPNESS, confidence, fit

    rng = np.random.default_rng(6)
    parts = {"aa": ["ta", "ko", "mi", "ra"], "bb": ["te", "ku", "mo", "ra"]}
    word = lambda p: "".join(rng.choice(parts[p], 3))
    drawn = [(" ".join(word("aa" if k % 2 else "bb") for _ in range(rng.integers(2, 9))) + f" {k}", "aa" if k % 2 else "bb") for k in range(2_600)]
    order = spark.createDataFrame(drawn, "text string, lang string").orderBy(F.xxhash64("text")).collect()
    rows = [(r["text"], r["lang"] if k < 2_000 else {"aa": "bb", "bb": "aa"}[r["lang"]]) for k, r in enumerate(order)]  # the last by digest have the other label
    rows += [(" ".join(["taqx", "kowz", "rafy", "mogh"][: k % 4 + 1]), "aa") for k in range(8)] + [("12 !", "aa"), ("no language", None)]
    model = fit(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    learned = [r for r in rows if r[1]]
    h, lengths = model.entropies([t for t, _ in learned])
    full = lengths > 0
    truth = np.array([model.languages.index(x) for _, x in learned])[full]
    loss = lambda s: -np.log(np.maximum(confidence(h[full], lengths[full], s)[np.arange(len(truth)), truth], 1e-9)).mean()
    assert model.sharpness == min(SHARPNESS, key=loss)
    assert model.ceiling == pytest.approx(1.05 * np.quantile(h[full].min(axis=1), 0.999), rel=1e-9)


def test_quantile_of_counted_numbers(spark):
    from evidentia.llm.langid import _ordered, _quantile

    x = np.concatenate([np.random.default_rng(7).normal(size=500), np.repeat([-0.0, 0.0, 2.5], 40), [1e300, -1e300, 5e-324]])
    for own in (x, x[:2], x[:1], np.repeat(x[:1], 9)):
        keys, n = np.unique(_ordered(own.view(np.int64)), return_counts=True)
        counts = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, n, strict=True)] * 2, "key long, n long")  # a key may come several times
        for q in (0.0, 0.3, 0.5, 0.999, 1.0):
            assert _quantile(counts, q) == pytest.approx(np.quantile(np.repeat(own, 2), q), rel=1e-12)


def test_kneser_ney_is_a_distribution():
    from evidentia.llm.langid import KneserNey, codes, grams, _own

    code, bounds = codes(["abracadabra banana cabana", "a barn"])
    gram, count = np.unique(grams(code)[_own(bounds)], return_counts=True)
    letters = np.unique(gram & np.uint64(0xFFFF))
    model = KneserNey(gram, count, len(letters))
    for context in np.unique(gram >> np.uint64(16))[:8]:
        p = np.exp(-model.surprise((context << np.uint64(16)) | letters)).sum()
        assert p == pytest.approx(1.0, abs=0.1) and p <= 1.0 + 1e-9


# --- packing


def test_tokenizer_memory_changes_nothing():
    from evidentia.llm.packing import ChunkTokenizer

    t = ChunkTokenizer(memory=5)
    texts = ["don't <|endoftext|>x İ ΑΣ ς a\x85b\x1cc \x01 é q J̌ ＡＢ x., it's. a,b _.", "", " \n", None, "Ünïcode…—“q” 12,34 日本語テスト", "Word, word. WORD; naïve co-op (3.5%)"] * 2
    for own, text in zip(t.encode(texts), texts, strict=True):
        assert list(own) == t.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_are_not_merged_anew_after_a_trim(spark):
    from evidentia.llm import packing

    class Counted:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, word):
            self.calls += 1
            return self.model.tokenize(word)

    t = packing.ChunkTokenizer(words=30)
    t.words.model = counted = Counted(t.words.model)
    texts, long = [f"{a}zq{b}xv. {b}{a}" for a in "abcdef" for b in "ghijkl"], "qxz" * 50
    want = [list(x) for x in t.encode(texts)]
    calls = counted.calls
    assert calls > 30 and want == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    t.trim()  # as between the tasks of a worker
    assert [list(x) for x in t.encode(texts)] == want and counted.calls == calls
    for k in range(3):  # words that are met no more go, long ones are not kept
        t.encode([" ".join(f"w{chr(97 + k)}{a}{b}" for a in "abcdef" for b in "ghijkl"), long])
        t.trim()
    assert len(t.words) + len(t.words.before) < 80 and long not in t.known and long not in t.words and long not in t.words.before


def test_the_faster_splitter_cuts_alike():
    import random

    import regex

    from evidentia.llm import packing

    t = packing.ChunkTokenizer()
    pattern = json.loads(t.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    every, rng = [chr(k) for k in range(0x530)], random.Random(1)
    text = "".join(every) + "".join(rng.choices(every + list("''stredvml\n") * 20, k=50_000))
    assert packing._splitter(pattern)(text) == regex.findall(pattern + r"|\n", text)
    assert packing._splitter(r"\w+|[\p{L}]+")("äb c") == ["äb", "c"]


def test_pack_holds_every_id_once(spark, odd, prose):
    from evidentia.llm.packing import ChunkTokenizer, pack

    docs = docs_of(spark, [(100 + k, " ".join(prose[: 1 + k % 12]), "en", "a") for k in range(60)]).unionByName(odd).repartition(3)
    rows = pack(docs).collect()
    tokenizer = ChunkTokenizer()
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc, own in texts.items():
        ids = [*tokenizer.encode([own[0]])[0], 1]
        assert sum(r["length"] for r in pieces[doc]) == len(ids) * len(own)
        for r in pieces[doc]:
            raw = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(raw) and r["doc_tokens"] == len(ids) and r["length"] > 0
    short = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        n = sum(r["length"] for r in own)
        assert n <= 2048
        short += n != 2048 and n & (n - 1) != 0
    assert short == 0
    assert pack(docs.limit(0)).count() == 0


def test_short_documents_fill_sequences(spark):
    from evidentia.llm.packing import pack

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hi").alias("text")).repartition(1)
    sums = [r["n"] for r in pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(n != 2048 for n in sums) <= 11 and all(n & (n - 1) == 0 for n in sums)


def test_chat_packing_binds_three_limits(spark):
    import __spark_entry__ as entry

    from evidentia.llm.packing import ChunkTokenizer

    sf = "/root/testdata/sf0.01"
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    tokenizer = ChunkTokenizer()
    ids_of = {}
    for conv, own in turns.items():
        own.sort()
        prompt, answer = ("\n".join(t for _, role, t in own if (role == "assistant") == said) for said in (False, True))
        head, tail = tokenizer.encode([prompt, answer])
        ids_of[conv] = (len(head), [*head, *tail, 1])
    sequences, held = collections.defaultdict(list), collections.Counter()
    for r in entry.queries()["chat_packing"](spark, sf).collect():
        sequences[r["sequence_id"]].append(r)
        held[r["conv_id"]] += r["length"]
    assert held == {c: len(ids) for c, (_, ids) in ids_of.items()}
    bound = [0, 0, 0]
    for own in sequences.values():
        free = [max(0, min(r["length"], ids_of[r["conv_id"]][0] - r["start"])) for r in own]
        used = (sum(r["length"] for r in own), len(own), sum(r["length"] for r in own) - sum(free))
        assert used[0] <= 2048 and used[1] <= 3 and used[2] <= 1536
        bound = [b + (u == limit) for b, u, limit in zip(bound, used, (2048, 3, 1536), strict=True)]
    assert all(bound), bound


def test_packer_keeps_all_limits():
    from evidentia.llm.packing import Item, VectorPacker

    rng = np.random.default_rng(1)
    packer, out = VectorPacker(100, 4, 60, pool=16), []
    lengths = [int(n) for n in rng.integers(1, 160, 300)]
    for k, n in enumerate(lengths):
        out += packer.add(Item(k, np.zeros(n, dtype="<u4"), 0, n, prompt=int(rng.integers(0, n + 1))))
    out += packer.flush()
    got = collections.Counter()
    for sequence in out:
        assert sum(x.length for x in sequence) <= 100 and len(sequence) <= 4 and sum(x.loss for x in sequence) <= 60
        for x in sequence:
            got[x.doc] += x.length
    assert [got[k] for k in range(300)] == lengths


# --- columns of any name


def test_clashing_columns_stay(spark, prose):
    from evidentia.llm.mixing import take_mix
    from evidentia.llm.near_dedup import keep_one
    from evidentia.llm.quality import keep_good
    from evidentia.llm.toxicity import Grammar, keep_harmless

    names = ["row", "id", "tid", "sum", "_key", "_u", "_copies", "copy", "_pin", "n", "words", "Host", "_size", "a b", "c.d"]
    docs = docs_of(spark, [(k, prose[k % 6] + f" t{k % 6}", "en", "s") for k in range(12)])
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    for stage, rows in ((keep_good, 12), (lambda d: keep_harmless(d, Grammar()), 12), (keep_one, 6), (take_mix, 12)):
        got = stage(docs)
        assert got.columns == docs.columns and got.count() == rows
        assert all(got.first()[name] == k for k, name in enumerate(names))


# --- registration


def test_every_operator_is_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    json.dumps(sorted(names))
