"""Toxicity by a weighted finite-state pattern grammar.

Words go through a lexicon into symbols: insults (learned words and stems, with weights), threats, targets,
intentions, negations, marks of reported speech, ends of clauses. A cascade of transducers, composed once into one
machine, rewrites the symbols: negation, reported speech, target and intention each mark insults and threats by what
stands in their clause; the last one writes matches, each with a learned weight on its arc. What is aimed at somebody
is known only at the end of a clause, so those transducers guess at its beginning and the wrong guess dies at its end.
A document's score is a logistic function of its weighted matches. Insults and all weights are learned from labelled
texts; the closed classes below are fixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import drop_written, materialize, words

WORD = re.compile(r"[^\W\d_]+")
#: Words, ends of clauses and quotation marks, for texts with matches.
TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+|[\"“”«»„]")

# Closed classes in English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself u he him his she her they them their us everyone everybody all people "
    "du dich dir dein deine deinen euch euer ihr ihn ihm sie ihnen uns alle "
    "tu te toi ton ta tes vous votre vos il elle lui leur eux elles tous "
    "tú ti usted ustedes vosotros os él ella ellos ellas les nos todos".split()
)
NEGATIONS = frozenset(
    "not no never none neither nor nobody nothing without cannot dont doesnt isnt arent wasnt wont cant "
    "nicht kein keine keinen nie niemand nichts ohne pas jamais personne rien sans nunca ningún ninguna nadie nada sin".split()
)
REPORTS = frozenset("said says say told tells wrote writes called calls reported reports claimed claims quoted quote sagte sagt schrieb dit disait écrit dijo dice escribió".split())
#: What a speaker is about to do.
INTENTIONS = frozenset("will shall ll gonna going werde werden wollen vais allons veux voy vamos quiero".split())
THREATS = frozenset(
    "kill hurt destroy murder punch stab shoot strangle burn beat töten umbringen erschlagen erschießen erwürgen verprügeln verbrennen "
    "tuer frapper poignarder étrangler brûler détruire matar golpear apuñalar estrangular quemar destruir".split()
)
#: Threats whose form is the intention.
FUTURES = frozenset("tuerai frapperai poignarderai étranglerai brûlerai détruirai mataré golpearé apuñalaré estrangularé quemaré destruiré".split())

#: Matches, in the order of the features; an insult counts with its weight, a threat with one.
MATCHES = ("plain", "aimed", "negated", "reported", "threat")
#: How far a negation reaches, in words.
REACH = 3
#: What the lexicon writes.
SYMBOLS = ("other", "insult", "threat", "future", "target", "intention", "negation", "report", "quote", "end", "line")


class Transducer:
    """States with arcs: for a state and a symbol, what is written, the weight, and the next state; starts and finals."""

    def __init__(self, starts: Iterable, finals: Iterable):
        self.starts, self.finals = list(starts), set(finals)
        self.arcs: dict[tuple, list[tuple]] = {}

    def arc(self, state, symbol: str, out: str, to, weight: float = 1.0) -> None:
        self.arcs.setdefault((state, symbol), []).append((out, weight, to))

    def paths(self, symbols: list[str]) -> list[tuple[list[str], float]]:
        """What is written on every path that reads all symbols and ends in a final state, with the product of its weights."""
        live = [(s, [], 1.0) for s in self.starts]
        for x in symbols:
            live = [(to, [*out, y], w * v) for s, out, w in live for y, v, to in self.arcs.get((s, x), [])]
        return [(out, w) for s, out, w in live if s in self.finals]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads what a reads and writes what b makes of what a writes."""
    out = Transducer([(p, q) for p in a.starts for q in b.starts], [])
    symbols: dict = {}
    for s, x in a.arcs:
        symbols.setdefault(s, []).append(x)
    todo, seen = list(out.starts), set(out.starts)
    while todo:
        p, q = todo.pop()
        if p in a.finals and q in b.finals:
            out.finals.add((p, q))
        for x in symbols.get(p, []):
            for y, w, p2 in a.arcs[p, x]:
                for z, v, q2 in b.arcs.get((q, y), []):
                    out.arc((p, q), x, z, (p2, q2), w * v)
                    if (p2, q2) not in seen:
                        seen.add((p2, q2))
                        todo.append((p2, q2))
    return out


def negation() -> Transducer:
    """Insults and threats up to REACH words after a negation are negated."""
    t = Transducer([0], range(REACH + 1))
    for n in range(REACH + 1):
        for x in SYMBOLS:
            y = f"negated {x}" if n and x in ("insult", "threat", "future") else x
            t.arc(n, x, y, REACH if x == "negation" else 0 if x in ("end", "line") else max(0, n - 1))
    return t


def speech() -> Transducer:
    """Insults and threats in quotation marks, or after a verb of saying in their clause, are reported."""
    t = Transducer(["direct"], ["direct", "said", "quoted"])
    symbols = [*SYMBOLS, *(f"negated {x}" for x in ("insult", "threat", "future"))]
    for s in ("direct", "said", "quoted"):
        for x in symbols:
            to = s
            if x == "quote":
                to = "said" if s == "quoted" else "quoted"
            elif x == "report" and s == "direct":
                to = "said"
            elif x == "line" or (x == "end" and s == "said"):
                to = "direct"
            t.arc(s, x, f"reported {x}" if s != "direct" and x in ("insult", "threat", "future") else x, to)
    return t


_MARKED = [f"{m} {x}" for m in ("negated", "reported") for x in ("insult", "threat", "future")]


def target() -> Transducer:
    """Insults of a clause that holds a target are aimed; threats of a clause without one are none.

    It guesses at the beginning of a clause: "none" must not meet a target, "some" must meet one before the end.
    """
    t = Transducer(["none", "some"], ["none", "met"])
    for s in ("none", "some", "met"):
        for x in [*SYMBOLS, *_MARKED]:
            if x in ("end", "line"):
                if s != "some":
                    t.arc(s, x, x, "none")
                    t.arc(s, x, x, "some")
            elif x == "target":
                if s != "none":
                    t.arc(s, x, x, "met")
            elif s == "none":
                t.arc(s, x, "other" if x in ("threat", "future", "reported threat", "reported future") else x, s)
            else:
                t.arc(s, x, "aimed insult" if x == "insult" else x, s)
    return t


def intention() -> Transducer:
    """Threats count in a clause that says what somebody is about to do; a future form says so itself."""
    t = Transducer(["none", "some"], ["none", "met"])
    for s in ("none", "some", "met"):
        for x in [*SYMBOLS, *_MARKED, "aimed insult"]:
            if x in ("end", "line"):
                if s != "some":
                    t.arc(s, x, x, "none")
                    t.arc(s, x, x, "some")
            elif x == "intention":
                if s != "none":
                    t.arc(s, x, x, "met")
            elif x in ("future", "reported future"):
                t.arc(s, x, x.replace("future", "threat"), s)
            else:
                t.arc(s, x, "other" if s == "none" and x in ("threat", "reported threat") else x, s)
    return t


def matching(weights: Iterable[float] = (1.0,) * len(MATCHES)) -> Transducer:
    """Writes matches, with their weights, and nothing for the rest."""
    t, weight = Transducer([0], [0]), dict(zip(MATCHES, weights, strict=True))
    match = {"insult": "plain", "aimed insult": "aimed", "negated insult": "negated", "reported insult": "reported", "threat": "threat", "reported threat": "reported"}
    for x in [*SYMBOLS, *_MARKED, "aimed insult"]:
        t.arc(0, x, match.get(x, ""), 0, weight.get(match.get(x, ""), 1.0))
    return t


def cascade(weights: Iterable[float] = (1.0,) * len(MATCHES)) -> list[Transducer]:
    return [negation(), speech(), target(), intention(), matching(weights)]


@cache
def machine() -> tuple[list[int], frozenset, list[dict[str, list[tuple[int, int]]]]]:
    """The composed cascade with numbered states: starts, finals, and for each state and symbol the matches (-1: none) and next states."""
    whole = cascade()[0]
    for t in cascade()[1:]:
        whole = compose(whole, t)
    number: dict = {}
    for s in chain(whole.starts, (a[2] for arcs in whole.arcs.values() for a in arcs)):
        number.setdefault(s, len(number))
    table: list[dict[str, list[tuple[int, int]]]] = [{} for _ in number]
    for (s, x), arcs in whole.arcs.items():
        if s in number:
            table[number[s]][x] = [(MATCHES.index(y) if y else -1, number[to]) for y, _, to in arcs]
    return [number[s] for s in whole.starts], frozenset(number[s] for s in whole.finals if s in number), table


def run(symbols: Iterable[tuple[str, float]]) -> list[float]:
    """Sum of the weights of each match on the path of symbols that ends well; a text's last symbol must be an end."""
    starts, finals, table = machine()
    live: dict[int, tuple[float, ...]] = dict.fromkeys(starts, (0.0,) * len(MATCHES))
    for x, weight in symbols:
        after: dict[int, tuple[float, ...]] = {}
        for s, found in live.items():
            for match, to in table[s].get(x, ()):
                # wherever two paths meet in a state the better one counts; guesses are such that only one is right
                own = found if match < 0 else (*found[:match], found[match] + weight, *found[match + 1 :])
                if to not in after or sum(after[to]) < sum(own):
                    after[to] = own
        live = after
    return list(max((f for s, f in live.items() if s in finals), key=sum, default=(0.0,) * len(MATCHES)))


@dataclass
class Grammar:
    """A learned lexicon with its weights. stems: beginnings of longer words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    weights: tuple[float, ...] = (2.0, 2.0, 1.0, 1.0, 1.0)
    memory: int = 300_000

    def __post_init__(self):
        self._lengths = sorted({len(s) for s in self.stems})
        self._known: dict[str, float] = {}

    def insult(self, word: str) -> float:
        """Weight of a lower-case word, 0 if it is none."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) > self.memory:
                self._known.clear()
            found = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self._lengths if n < len(word))])
            self._known[word] = found
        return found

    def symbols(self, low: str) -> Iterator[tuple[str, float]]:
        """The lexicon: symbols of a lower-case text, with weights."""
        for m in TOKEN.findall(low):
            if m[0] in "\"“”«»„":
                yield "quote", 0.0
            elif m[0] in ".!?;\n":
                yield ("line" if m[0] == "\n" else "end"), 0.0
            elif weight := self.insult(m):
                yield "insult", weight
            elif m in THREATS:
                yield "threat", 1.0
            elif m in FUTURES:
                yield "future", 1.0
            else:
                yield ("target" if m in TARGETS else "negation" if m in NEGATIONS else "report" if m in REPORTS else "intention" if m in INTENTIONS else "other"), 0.0
        yield "line", 0.0

    def matches(self, text: str | None) -> list[float]:
        """Sum of weights of each kind of match in a whole text."""
        low = (text or "").lower()
        insult = self.insult
        if not any(insult(w) or w in THREATS or w in FUTURES for w in set(WORD.findall(low))):
            return [0.0] * len(MATCHES)
        return run(self.symbols(low))

    def score(self, found: list[float]) -> float:
        z = self.bias + sum(w * math.log1p(x) for w, x in zip(self.weights, found, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str | None) -> set[str]:
    """Words of a text, and beginnings of three to six letters (with a dash) of its longer words."""
    out = set(WORD.findall((text or "").lower()))
    return out | {f"{w[:n]}-" for w in out for n in range(3, 7) if len(w) > n}


def _counted(sample: DataFrame, wanted: dict[str, int] | None = None) -> DataFrame:
    """term, toxic, clean: how many texts of sample (text, toxic) of a partition hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (toxic if label else clean).update(_terms(text))
        terms = [*toxic, *(t for t in clean if t not in toxic)]
        for k in range(0, len(terms), 50_000):
            part = terms[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")


def fit(sample: DataFrame, *, precision: float = 0.95, cover: int = 4) -> Grammar:
    """Learns a grammar from sample (text, toxic 0/1), which the caller has bounded.

    Terms that few clean texts hold are candidates; each needs 0.4 % of the toxic texts, so there are at most 250 times
    as many candidates as a toxic text has terms. Insults are
    chosen one by one, each time the term that most toxic texts hold that are not yet explained `cover` times, so a
    term that only copies of one text hold is hardly ever needed. Of near copies, found by their smallest shingle, one
    counts, chosen by a digest. Without labelled texts of both kinds the grammar stays empty.
    """
    sample = sample.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    smallest = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(5)])))
    sample = sample.withColumn("w", words("text")).withColumn("key", smallest).groupBy("key", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")
    sample = materialize(sample, "labelled")
    try:
        size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = size.get(1, 0), size.get(0, 0)
        if not n1 or not n0:
            return Grammar()
        least = max(2, round(0.004 * n1))
        counts = _counted(sample).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        rows = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))).orderBy(F.desc("toxic"), "clean", "term").collect()
        candidates = {r["term"]: (r["toxic"], r["clean"]) for r in rows}

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sorted(t for t in _terms(x) if t in candidates) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["terms"])

        holders: dict[str, set[int]] = {t: set() for t in candidates}
        for k, r in enumerate(sample.where("toxic = 1").select("text").mapInArrow(hits, "terms array<string>").toLocalIterator()):
            for t in r["terms"]:
                holders[t].add(k)
        grammar = Grammar(*_chosen(holders, candidates, n1, n0, least, cover))

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([grammar.matches(x) for x in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["found", "toxic"])

        table = sample.mapInArrow(features, "found array<double>, toxic int").toArrow()
        found = np.array(table.column("found").to_pylist(), dtype=float).reshape(-1, len(MATCHES))
        grammar.bias, grammar.weights = _logistic(np.log1p(found), np.array(table.column("toxic").to_pylist(), dtype=float))
        return grammar
    finally:
        drop_written(sample)


def _chosen(holders: dict[str, set[int]], candidates: dict[str, tuple[int, int]], n1: int, n0: int, least: int, cover: int) -> tuple[dict[str, float], dict[str, float]]:
    words, stems = {}, {}
    open_ = {t: len(h) for t, h in holders.items()}
    explained: Counter = Counter()
    order = lambda t: (open_[t], not t.endswith("-"), -candidates[t][1], len(t), t)
    while open_:
        best = max(open_, key=order)
        plain = best.rstrip("-")
        if any(plain.startswith(c) or c.startswith(plain) for c in chain(words, stems)):  # says the same as one chosen
            del open_[best]
            continue
        gain = sum(explained[d] < cover for d in holders[best])
        if gain < open_[best]:  # its count was from before others were chosen
            open_[best] = gain
            if gain < least:
                del open_[best]
            continue
        if gain < least:
            break
        toxic, clean = candidates[best]
        weight = math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))
        (stems if best.endswith("-") else words)[plain] = max(weight, 0.1)
        explained.update(holders[best])
        del open_[best]
    return words, stems


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> tuple[float, tuple[float, ...]]:
    """Non-negative weights by projected gradient steps with a diagonal scale."""
    w, b = np.ones(x.shape[1]), -2.0
    scale = 1.0 / (0.25 * (x**2).mean(axis=0) * x.shape[1] + 1e-2)
    for _ in range(steps):
        error = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w = np.maximum(0.0, w - scale * ((x * error[:, None]).mean(axis=0) + ridge * (w - 1.0)))
        b -= 2.0 * error.mean()
    return float(b), tuple(map(float, w))


def score(docs: DataFrame, grammar: Grammar, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, found (weight of each kind of match) per row; only the text counts.

    Null and empty texts have no match, and the score of that. Repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.matches(x) for x in batch.column(1).to_pylist()]
            scores = [own.score(x) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "score", "predicted", "found"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, found array<double>")


def keep_harmless(docs: DataFrame, grammar: Grammar, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([own.score(own.matches(x)) < threshold for x in batch.column(at).to_pylist()], pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots don't pass
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def training_sample(docs: DataFrame, labels: DataFrame, *, rows: int = 20_000) -> DataFrame:
    """text, toxic of at most `rows` labelled documents whose crc32(doc_id) mod 5 is not 0, chosen by a digest of doc_id.

    `rows` bounds what is learned from and what is broadcast here; a document with several labels is toxic if one says so.
    """
    train = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    picked = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")
