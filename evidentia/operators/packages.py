"""Evidence packages: an anchor record with what explains it, and the choice of packages under a budget for all questions at once.

Everything that follows from an order is windows: BM25 of every route over a question's packages, the rankings, their
fusion, and who may ask for a place in which turn. What is left for a loop is a table of requests per question, whose
size follows the budget and not the number of packages: of a ranking only rows that a full page can't all block.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import labels as L
from ..session import staged
from .text import counted, tokens


@dataclass(frozen=True)
class PackageOptions:
    budget: int = 24
    least: int = 4
    papers: int = 1  # a question about several papers is to have packages of so many
    adaptive: bool = True  # stop once everything asked for is there
    per_modality: int = 2
    supporting: int = 0  # text packages of each covered paper
    page_anchors: int = 0  # text packages of each page, beyond the page cap
    chars: int = 80_000  # 0: no limit
    neighbours: int = 1
    rrf_k: int = 60
    pool: int = 0  # candidates from each ranking; 0: all
    page_cap: int = 2


# Record types whose records with one label belong together, and words that ask for or name kinds of sections.
COMPANIONS = ("table_caption", "figure_caption", "table", "figure", "equation", "algorithm")
ASKED_SECTIONS = {
    "method": r"\b(?:method|methodology|approach|framework|architecture|model)\b",
    "results": r"\b(?:experiment|result|evaluation|ablation|benchmark)\b",
    "introduction": r"\b(?:introduction|background|related work|literature review)\b",
}
SECTION_TITLES = {
    "method": (("method", "approach"), r"\b(?:method|approach|framework|architecture|model)\b"),
    "results": (("results", "experiments", "evaluation", "analysis"), r"\b(?:experiment|result|evaluation|ablation|analysis)\b"),
    "introduction": (("introduction", "background", "related_work"), r"\b(?:introduction|background|related work|literature review)\b"),
}
_OBJECT = r"(?i)(?<!\w)(table|tab\.?|figure|fig\.?|equation|eq\.?|algorithm|alg\.?)\s*\(?\s*((?:[A-Za-z]\.)?[0-9]+[A-Za-z]?(?:\.[0-9A-Za-z]+)*)\s*\)?(?!\w)"
_CITED = r"(?i)(?:reference|ref\.)\s*\[?(\d{1,3})\]?|\[(\d{1,3})\]"
#: The order in which kinds of routes ask for a place, and how.
_TURNS = {"slot_paper": 1, "slot": 2, "fallback_slot": 3, "claim": 6, "paper_claim": 7, "paper_local": 8}


def _named(text: Column) -> Column:
    """Objects that a text names, as `t 3`, `f 3`, `e 3` and `a 3`."""
    one = lambda m: F.concat(F.lower(F.substring(m, 1, 1)), F.lit(" "), F.lower(F.regexp_extract(m, _OBJECT, 2)))
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_OBJECT), 0), one))


def canonical(records: DataFrame) -> DataFrame:
    """records with their official kind, one for each record_id: of several the longest text, then the first by place; other kinds and rows without an id go.

    records: paper_id, record_id, page, reading, record_type, source_type, section_id, label, text, and more.
    """
    known = records.withColumn("kind", L.official_type(F.col("record_type"), F.col("source_type"))).where(F.col("kind").isNotNull() & (F.coalesce("record_id", F.lit("")) != ""))
    best = W.partitionBy("record_id").orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "paper_id", "page", "reading", "text")
    return known.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn").withColumn("page", F.coalesce(F.col("page").cast("long"), F.lit(0))).withColumn("reading", F.coalesce(F.col("reading").cast("long"), F.lit(0)))


def package_records(anchors: DataFrame, context: DataFrame, neighbours: int = 1) -> DataFrame:
    """anchor_id, record_id, place: the records of each anchor's package in reading order. Both sides are canonical() rows.

    A text has its neighbours in its section. An object has the texts that name its label (twice `neighbours`, those of
    its section, then the nearest, first), or else neighbouring texts; also records of its kind and label; a citation also the first
    other citation of its number. An anchor that the context lacks is in its package all the same.
    """
    at, order = ["page", "reading"], ["page", "reading", "record_id"]
    every = context.withColumn("_at", F.row_number().over(W.partitionBy("paper_id", "section_id").orderBy(*order)))
    own = anchors.select("paper_id", "record_id", "kind", "label", "text", "page", "reading", "section_id").withColumnRenamed("record_id", "anchor_id")
    placed = own.join(every.select(F.col("record_id").alias("anchor_id"), "_at"), "anchor_id", "left").withColumn("_at", F.coalesce("_at", F.lit(1)))
    near = placed.select("anchor_id", "paper_id", "section_id", F.col("kind").alias("_kind"), F.explode(F.sequence(F.col("_at") - neighbours, F.col("_at") + neighbours)).alias("_at"))
    near = near.join(every.select("paper_id", F.col("section_id").alias("_section"), "_at", "record_id", "kind", "page", "reading"), ["paper_id", "_at"]).where(F.col("section_id").eqNullSafe(F.col("_section")))
    nearby = near.where((F.col("_kind") == "text_span") | (F.col("kind") == "text_span")).select("anchor_id", "record_id", "_kind", *at)
    texts = context.where("kind = 'text_span'").select("paper_id", "record_id", F.col("page").alias("_page"), F.col("reading").alias("_reading"), F.col("section_id").alias("_section"), F.explode(_named(F.col("text"))).alias("_name"))
    things = own.where("kind <> 'text_span'").withColumn("_name", F.get(_named(F.regexp_extract(F.trim(F.coalesce("label", F.lit(""))), f"^{_OBJECT}$", 0)), 0))
    told = things.join(texts, ["paper_id", "_name"])
    closest = W.partitionBy("anchor_id").orderBy((~F.col("section_id").eqNullSafe(F.col("_section"))).cast("int"), F.abs(F.col("page") - F.col("_page")), F.abs(F.col("reading") - F.col("_reading")), "_page", "_reading", "record_id")
    told = told.withColumn("_rn", F.row_number().over(closest)).where(F.col("_rn") <= max(1, 2 * neighbours)).select("anchor_id", "record_id", F.col("_page").alias("page"), F.col("_reading").alias("reading"))
    beside = nearby.where("_kind = 'text_span'").drop("_kind").unionByName(nearby.where("_kind <> 'text_span'").drop("_kind").join(told.select("anchor_id").distinct(), "anchor_id", "left_anti"))
    flat = F.lower(F.regexp_replace(F.trim(F.coalesce("label", F.lit(""))), r"\s+", " "))
    labelled = context.where(F.col("record_type").isin(*COMPANIONS)).select("paper_id", "kind", flat.alias("_label"), "record_id", F.col("page").alias("_page"), F.col("reading").alias("_reading")).where("_label <> ''")
    companions = own.where("kind <> 'text_span'").withColumn("_label", flat).join(labelled, ["paper_id", "kind", "_label"]).select("anchor_id", "record_id", F.col("_page").alias("page"), F.col("_reading").alias("reading"))
    number = F.regexp_extract(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit(""))), _CITED, 1)
    number = F.when(number != "", number).otherwise(F.regexp_extract(F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("text", F.lit(""))), _CITED, 2))
    cited = context.where("kind = 'citation_context'").withColumn("_number", number).where("_number <> ''")
    first = cited.withColumn("_rn", F.row_number().over(W.partitionBy("paper_id", "_number").orderBy(*order))).where("_rn <= 2").groupBy("paper_id", "_number").agg(F.array_sort(F.collect_list(F.struct("_rn", "record_id", "page", "reading"))).alias("_two"))
    entry = own.where("kind = 'citation_context'").withColumn("_number", number).join(first, ["paper_id", "_number"])
    entry = entry.select("anchor_id", F.get(F.filter("_two", lambda x: x["record_id"] != F.col("anchor_id")), 0).alias("_x")).where("_x is not null").select("anchor_id", "_x.record_id", "_x.page", "_x.reading")
    # every member brings its place with it, so members are dealt by anchor once, where each is kept once and numbered
    members = beside.unionByName(told).unionByName(companions).unionByName(entry).unionByName(own.select("anchor_id", F.col("anchor_id").alias("record_id"), *at)).repartition("anchor_id")
    once = members.withColumn("_rn", F.row_number().over(W.partitionBy("anchor_id", "record_id").orderBy(*at))).where("_rn = 1")
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy("page", "reading", "record_id")).cast("long")
    return once.select("anchor_id", "record_id", place.alias("place"))


def _column_bonus(question: Column, route: Column) -> Column:
    """How well a table's columns answer a route to a paper's table: a benchmark, or a data set with its IPC, that the route names. Else 0; -1 for a table of costs where accuracy is asked."""
    text = F.lower("text")
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    accuracy = F.concat_ws(" ", route, question).rlike(r"(?i)\b(?:test\s+)?accuracy\b")
    names = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(route, F.lit(r"\b[A-Za-z]+(?:-[A-Za-z]+)*-?\d+\b"), 0), flat), lambda n: n != ""))
    matched = F.aggregate(names, F.lit(0), lambda s, n: s + F.size(F.filter(columns, lambda c: F.contains(flat(c), n))))
    costs = ~text.rlike(r"\baccuracy\b") & text.rlike(r"\b(?:speed|memory|latency|runtime)\b")
    data = flat(F.regexp_extract(route, r"(?i)\bdataset\s*:\s*([A-Za-z][\w-]*(?:\s+[A-Za-z][\w-]*){0,3})", 1))
    ipc = F.regexp_extract(route, r"(?i)\bipc\s*[=:]\s*(\d+)\b", 1)
    alone = lambda c: F.regexp_like(c, F.concat(F.lit(r"(?<!\d)"), ipc, F.lit(r"(?!\d)")))
    both = (data != "") & (ipc != "")
    joint = F.when(both & F.exists(columns, lambda c: F.contains(flat(c), data) & alone(F.lower(c))), 2).when(both & F.contains(flat(F.col("text")), data) & text.rlike(r"\bipc\b") & alone(text), 1).otherwise(0)
    by_name = F.when(matched > 0, F.least(F.lit(3), matched + 1)).when(F.exists(names, lambda n: F.contains(flat(F.col("text")), n)), 1).otherwise(joint)
    return F.when(F.col("kind") != "table", 0).when(accuracy, F.when(costs, -1).otherwise(by_name)).otherwise(joint)


def asked_routes(questions: DataFrame, routes: DataFrame) -> DataFrame:
    """What every question asks for, one row each: with_targets(), _question, routes (way, route, text, terms with their counts, kinds, paper_id) and terms, all words of its routes.

    routes: query_id, route (a number), way (of _TURNS), text, kinds (empty: all), paper_id. Besides them: the question itself, and each kind with the question.
    """
    plain = routes.select("query_id", "way", F.col("route").cast("long").alias("route"), "text", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"), F.col("paper_id").cast("string").alias("paper_id"))
    same = plain.where("way = 'claim'").groupBy("query_id", "text").agg(F.min("route").alias("route"))  # a claim that repeats another or the question is none
    same = same.join(questions.select("query_id", F.col("question").alias("text")).hint("merge"), ["query_id", "text"], "left_anti").select("query_id", "route")
    plain = plain.where("way <> 'claim'").unionByName(plain.where("way = 'claim'").join(same.hint("merge"), ["query_id", "route"], "left_semi"))
    one = lambda way, route, text, kinds: F.struct(F.lit(way).alias("way"), F.lit(route).cast("long").alias("route"), text.alias("text"), kinds.cast("array<string>").alias("kinds"), F.lit(None).cast("string").alias("paper_id"))
    own = [one("query", 0, F.col("question"), F.array())] + [one("kind", i, F.concat_ws(" ", F.lit(k), "question"), F.array(F.lit(k))) for i, k in enumerate(sorted(L.OFFICIAL_TYPES))]
    every = plain.unionByName(questions.select("query_id", F.explode(F.array(*own)).alias("r")).select("query_id", "r.*")).withColumn("terms", counted(tokens(F.col("text"))))
    told = every.groupBy("query_id").agg(F.collect_list(F.struct("way", "route", "text", F.map_from_entries("terms").alias("terms"), "kinds", "paper_id")).alias("routes"), F.array_distinct(F.flatten(F.collect_list(F.transform("terms", lambda t: t["term"])))).alias("terms"))
    return with_targets(questions).join(told.hint("merge"), "query_id")


def rankings(asked: DataFrame, packages: DataFrame, options: PackageOptions, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """One row of facts for each package of a question, with rrf, _best (its best rank) and slots: way, route and place where a ranking of a route may place it.

    packages: query_id, package_id, at (their order), paper_id, page, kind, label, section_type, section_title, columns, text, score, visual. Each
    route ranks by BM25 over the packages of its question, which are the whole corpus; other rankings are the relevance score,
    relevance within each asked kind, the visual score, layout, and numbered objects that the question names.

    Rows are dealt by question once. Counts, windows and sums of a question then stay where it is, and texts go as soon as they are counted. What is asked is
    dealt too: a file of it is a few hundredths of its rows in memory, so Spark would broadcast more of it than a driver holds.
    """
    by = W.partitionBy("query_id")
    known = packages.withColumn("package_id", F.col("package_id").cast("string")).withColumn("paper_id", F.col("paper_id").cast("string")).join(asked.hint("merge"), "query_id")
    fits = lambda r: ((F.size(r["kinds"]) == 0) | F.array_contains(r["kinds"], F.col("kind"))) & (r["paper_id"].isNull() | (r["paper_id"] == F.col("paper_id")))
    bonus = F.transform(F.filter("routes", lambda r: (r["way"] == "slot_paper") & F.coalesce(fits(r), F.lit(False))), lambda r: F.struct(r["route"].alias("route"), _column_bonus(F.col("question"), r["text"]).cast("double").alias("bonus")))
    words = tokens(F.col("text"))
    facts = known.select(
        "query_id", "package_id", "at", "paper_id", F.col("page").cast("string").alias("page"), "kind", F.coalesce(F.col("score").cast("double"), F.lit(-1.0)).alias("score"), F.col("visual").cast("double").alias("visual"),
        is_target().alias("target"), F.array_contains("modalities", F.col("kind")).alias("asked"), F.array_position("modalities", F.col("kind")).alias("_modality"), layout_score().cast("double").alias("_layout"), _in_asked_section().alias("structural"), "several",
        F.size(words).alias("_len"), counted(F.filter(words, lambda x: F.array_contains("terms", x))).alias("_hits"), bonus.alias("_bonus"),
    )
    facts = facts.withColumn("_n", F.count("*").over(by)).withColumn("_avg", F.avg("_len").over(by))
    own = [c for c in facts.columns if c not in ("query_id", "package_id", "_len", "_hits", "_n", "_avg")]
    hits = facts.select("query_id", "package_id", F.struct(*own).alias("_p"), "_len", "_n", "_avg", F.explode_outer("_hits").alias("_h")).withColumn("_df", F.count("*").over(W.partitionBy("query_id", "_h.term")))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("_h.n") * (k1 + 1) / (F.col("_h.n") + k1 * (1 - b + b * F.greatest(F.lit(1), F.col("_len")) / F.greatest(F.col("_avg"), F.lit(1e-9))))
    scored = hits.groupBy("query_id", "package_id").agg(F.first("_p").alias("_p"), F.collect_list(F.when(F.col("_h").isNotNull(), F.struct(F.col("_h.term").alias("term"), part.alias("part")))).alias("_hits"))
    rows = scored.select("query_id", "package_id", "_p.*", "_hits").join(asked.select("query_id", "routes").hint("merge"), "query_id")
    one = lambda way, route, first, second=F.lit(0.0): F.struct(F.lit(way).alias("way") if isinstance(way, str) else way.alias("way"), route.cast("long").alias("route"), first.cast("double").alias("first"), second.alias("second"))
    bm25 = lambda r: F.round(F.aggregate("_hits", F.lit(0.0), lambda s, h: s + F.coalesce(F.try_element_at(r["terms"], h["term"]) * h["part"], F.lit(0.0))), 9)
    extra = lambda r: F.when(r["way"] == "slot_paper", F.coalesce(F.get(F.filter("_bonus", lambda x: x["route"] == r["route"]), 0)["bonus"], F.lit(0.0))).otherwise(0.0)
    by_text = F.transform(F.filter("routes", lambda r: F.coalesce(fits(r), F.lit(False))), lambda r: one(r["way"], r["route"], extra(r), bm25(r)))
    zero = F.lit(0)
    more = F.array(one("relevance", zero, F.col("score")), F.when(F.col("asked"), one("modality", F.col("_modality"), F.col("score"))), F.when(F.col("visual").isNotNull(), one("visual", zero, F.col("visual"))), one("layout", zero, F.col("_layout")), F.when(F.col("target"), one("target", zero, zero)))
    left = ["at", "paper_id", "page", "kind", "score", "target", "asked", "structural", "several"]
    rows = rows.select("query_id", "package_id", *left, F.explode(F.concat(by_text, F.filter(more, lambda x: x.isNotNull()))).alias("r")).select("query_id", "package_id", F.struct(*left).alias("_p"), "r.*")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "way", "route").orderBy(F.desc("first"), F.desc("second"), F.col("_p.at")))).drop("first", "second")
    cap = max(1, options.page_cap)
    page = W.partitionBy("query_id", "way", "route", F.coalesce("_p.paper_id", F.lit("")), F.col("_p.page")).orderBy("rank")
    ranked = ranked.withColumn("_open", F.col("way").isin(*_TURNS) & ((F.row_number().over(page) <= cap) | (F.col("rank") == 1)))
    place = F.sum(F.col("_open").cast("long")).over(W.partitionBy("query_id", "way", "route").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    slot = F.when(F.col("_open"), F.struct("way", "route", place.alias("place")))
    leads = (F.col("way").isin("slot", "fallback_slot", "slot_paper") & (F.col("rank") == 1)).cast("int")
    fused = ranked.withColumn("_slot", slot).groupBy("query_id", "package_id").agg(F.first("_p").alias("_p"), F.round(F.sum(1.0 / (options.rrf_k + F.col("rank"))), 12).alias("rrf"), F.min("rank").alias("_best"), F.sum(leads).alias("_leads"), F.collect_list("_slot").alias("slots"))
    budget = F.greatest(F.lit(max(1, options.budget)), F.sum("_leads").over(by).cast("int"))
    return fused.select("query_id", "package_id", "_p.*", "rrf", "_best", "slots", budget.alias("budget")).withColumn("paper_id", F.coalesce("paper_id", F.lit("")))


def with_targets(questions: DataFrame) -> DataFrame:
    """questions with modalities (sorted asked kinds; none: texts), numbers of named objects by kind, and asked section families."""
    hint = F.coalesce("hint", "question")
    number = lambda p: F.nullif(F.regexp_extract(hint, p, 1), F.lit("")).cast("long").cast("string")
    named = {
        "table": number(r"(?i)\btable\s*(\d+)"),
        "figure": number(r"(?i)\b(?:figure|fig\.)\s*(\d+)"),
        "equation_algorithm": number(r"(?i)\b(?:equation|eq\.|algorithm)\s*\(?(\d+)\)?"),
        "citation_context": F.coalesce(number(r"(?i)\b(?:reference|ref\.)\s*\[?(\d{1,3})\]?"), number(r"(?i)\b(\d{1,3})(?:st|nd|rd|th)\s+reference\b")),
    }
    given = F.array_distinct(F.filter(F.transform(F.coalesce("kinds", F.array().cast("array<string>")), L.source_type), lambda k: k.isin(*L.OFFICIAL_TYPES)))
    found = F.array_sort(F.array_union(L.numbered_types(hint), given))
    sections = F.filter(F.array(*[F.when(F.lower(F.coalesce("question", F.lit(""))).rlike(p), F.lit(s)) for s, p in ASKED_SECTIONS.items()]), lambda s: s.isNotNull())
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("number")) for k, n in named.items()])
    return questions.select("query_id", "question", F.coalesce("several", F.lit(False)).alias("several"), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("text_span"))).alias("modalities"), pairs.alias("named"), sections.alias("sections"))


def is_target() -> Column:
    """Whether a package (kind, label) is an object that the question names by number."""
    return F.exists("named", lambda x: (x["kind"] == F.col("kind")) & x["number"].isNotNull() & F.regexp_like(F.coalesce("label", F.lit("")), F.concat(F.lit(r"\b"), x["number"], F.lit(r"\b"))))


def layout_score() -> Column:
    return F.array_contains("modalities", F.col("kind")).cast("int") + F.when(is_target(), 3).otherwise(0) + F.when((F.col("kind") != "text_span") & (F.coalesce("label", F.lit("")) != ""), 0.1).otherwise(0)


def _in_asked_section() -> Column:
    out = F.lit(False)
    for name, (types, titles) in SECTION_TITLES.items():
        out = out | (F.array_contains("sections", name) & (F.lower(F.coalesce("section_type", F.lit(""))).isin(*types) | F.lower(F.coalesce("section_title", F.lit(""))).rlike(titles)))
    return out


def requests(facts: DataFrame, asked: DataFrame, options: PackageOptions) -> DataFrame:
    """What asks for a place, in which turn: query_id, turn, who, then, place, mode, package_id and the package's facts (rows of rankings()).

    Requests are taken by turn, who and then; rows of one request stand by place. Modes: serve (the first row that can
    be taken, unless a row of the ranking already is), take (the first that can be taken), first (the first or none),
    force (all, whatever the page holds), try (all; only for papers that are covered) and pool (for the last turn, in order of relevance).
    Rows that can't decide anything are left out: behind so many pages that not all can be full, and beyond the cap of a page.

    Places are windows within a question over rows that stay where they are; what a window doesn't count is a partition of its own.
    """
    best, cap = [F.desc("score"), F.desc("rrf"), F.asc("at")], max(1, options.page_cap)
    nth = lambda *by: F.row_number().over(W.partitionBy("query_id", *by).orderBy(*best)).cast("long")
    goal = F.least("budget", F.when(F.col("several"), F.lit(max(1, options.papers))).otherwise(1))
    order = lambda c: F.format_string("%012d", c)
    blank, one = F.lit(""), F.lit(1)
    ask = lambda when, turn, who, then, place, mode: F.when(when, F.struct(F.lit(turn).alias("turn"), who.alias("who"), then.alias("then"), place.cast("long").alias("place"), F.lit(mode).alias("mode"), F.lit(None).cast("string").alias("way"), F.lit(None).cast("long").alias("route")))
    rows = facts.withColumn("candidate", F.lit(options.pool <= 0) | (F.col("_best") <= options.pool))
    pool, several = F.col("candidate"), F.col("candidate") & F.col("several")
    rows = rows.withColumn("_target", F.row_number().over(W.partitionBy("query_id", "target").orderBy(F.desc("score"), "at")))
    rows = rows.withColumn("_kind", nth("candidate", "kind")).withColumn("_paper", nth("candidate", "paper_id")).withColumn("_pair", nth("candidate", "paper_id", "kind"))
    rows = rows.withColumn("_struct", nth("candidate", "structural", "paper_id", "kind")).withColumn("_papers", nth("candidate", F.col("_paper") == 1))
    wanted = [
        ask(F.col("target"), 4, blank, blank, F.col("_target"), "force"),
        ask(pool & F.col("asked") & (F.col("_kind") == 1), 5, F.col("kind"), blank, one, "first"),
        ask(several & (F.col("_paper") == 1) & (F.col("_papers") <= goal), 9, order(F.col("_papers")), blank, one, "first"),
        ask(several & F.col("asked") & F.col("structural") & (F.col("_struct") == 1), 10, F.col("paper_id"), F.concat(F.lit("0 "), F.col("kind"), F.lit(" 0")), one, "try"),
        ask(several & F.col("asked") & (F.col("_pair") <= max(1, options.per_modality)), 10, F.col("paper_id"), F.concat(F.lit("0 "), F.col("kind"), F.lit(" 1")), F.col("_pair"), "try"),
    ]
    text = F.col("kind") == "text_span"
    if options.supporting > 0:
        wanted.append(ask(several & text & (F.col("_pair") <= options.supporting), 10, F.col("paper_id"), F.lit("1"), F.col("_pair"), "try"))
    if options.page_anchors > 0:
        rows = rows.withColumn("_anchor", nth("candidate", "kind", "paper_id", "page"))
        wanted.append(ask(pool & text & (F.col("_anchor") <= options.page_anchors), 11, F.concat_ws("\1", "paper_id", F.coalesce(F.lpad("page", 12, "0"), F.lit(""))), blank, F.col("_anchor"), "force"))
    rows = rows.withColumn("_fill", pool & (nth("candidate", "kind", "paper_id", "page") <= cap))
    rows = rows.withColumn("_n", nth("_fill", "kind")).withColumn("_first", nth("_fill", "kind", "paper_id") == 1)
    rows = rows.withColumn("_others", nth("_fill", "kind", "_first"))
    rows = rows.withColumn("_fill", F.col("_fill") & ((F.col("_n") <= 2 * F.col("budget")) | (F.col("_first") & (F.col("_others") <= 2 * F.col("budget")))))
    wanted.append(ask(F.col("_fill"), 99, blank, blank, nth("_fill"), "pool"))
    turn = lambda w: F.coalesce(*[F.when(w == name, F.lit(t)) for name, t in _TURNS.items()])
    mode = lambda w: F.when(w.isin("slot", "slot_paper"), "serve").when(w == "fallback_slot", "take").otherwise("first")
    kept = lambda w: F.when(w.isin("claim", "paper_claim", "paper_local"), 1).otherwise(2 * F.col("budget") + cap)
    slots = F.transform(F.filter("slots", lambda x: x["place"] <= kept(x["way"])), lambda x: F.struct(turn(x["way"]).alias("turn"), order(x["route"]).alias("who"), blank.alias("then"), x["place"].alias("place"), mode(x["way"]).alias("mode"), x["way"].alias("way"), x["route"].alias("route")))
    rows = rows.withColumn("goal", goal).withColumn("_asks", F.array(*wanted))  # before the filter: places are made by windows
    rows = rows.select("query_id", "package_id", "paper_id", "page", "kind", "several", "budget", "goal", F.explode(F.concat(F.filter("_asks", lambda x: x.isNotNull()), slots)).alias("a")).select("*", "a.*").drop("a")
    limits = F.get(F.filter("routes", lambda r: (r["way"] == F.col("way")) & (r["route"] == F.col("route"))), 0)
    return rows.join(asked.select("query_id", "modalities", "routes").hint("merge"), "query_id").select(*rows.columns, "modalities", limits["kinds"].alias("only_kinds"), limits["paper_id"].alias("only_paper")).drop("way", "route")


def _choose(rows: pd.DataFrame, options: PackageOptions) -> list[tuple]:
    """The selection of one question from its requests: (entry, name, place, detail) for packages, slots and the reason to stop."""
    info = {r.package_id: r for r in rows.itertuples()}
    any_ = rows.iloc[0]
    budget, several, asked, goal = int(any_["budget"]), bool(any_["several"]), set(any_["modalities"]), int(any_["goal"])
    taken, pages, out = [], Counter(), []
    page_of = lambda p: (info[p].paper_id, info[p].page)

    def take(p, force=False) -> bool:
        if p in taken or len(taken) >= budget or not force and pages[page_of(p)] >= max(1, options.page_cap):
            return False
        taken.append(p)
        pages[page_of(p)] += 1
        return True

    covered = None
    names = {1: "slot_paper", 2: "slot", 3: "fallback_slot"}
    for (turn, who, _), group in rows[rows["mode"] != "pool"].sort_values(["turn", "who", "then", "place"], kind="stable").groupby(["turn", "who", "then"], sort=True):
        if turn >= 10 and covered is None:
            covered = {info[p].paper_id for p in taken}
        own, mode = group["package_id"].tolist(), group["mode"].iloc[0]
        if mode in ("serve", "take"):
            kinds, paper = group["only_kinds"].iloc[0], group["only_paper"].iloc[0]  # whom the whole ranking holds
            held = mode == "serve" and any((not len(kinds) or info[p].kind in kinds) and (paper is None or info[p].paper_id == paper) for p in taken)
            served = held or any(take(p) for p in own)
            out.append(("slot", f"{names[turn]}:{int(who)}", None, "served" if served else "not served"))
        elif mode == "first":
            take(own[0])
        elif mode == "force" or who in covered:
            for p in own:
                take(p, mode == "force")
    kinds, papers, why = {info[p].kind for p in taken}, {info[p].paper_id for p in taken}, "budget"
    pool = [p for p in rows[rows["mode"] == "pool"].sort_values("place")["package_id"] if p not in taken]
    while len(taken) < budget:
        open_ = [p for p in pool if pages[page_of(p)] < max(1, options.page_cap)]
        if not open_:
            why = "no package on an open page"
            break
        gain = lambda p: (info[p].kind in asked and info[p].kind not in kinds) + (several and len(papers) < goal and info[p].paper_id not in papers)  # noqa: B023, E731
        best = max(open_, key=gain)  # the first of the best: the pool is in order
        if options.adaptive and len(taken) >= min(budget, max(1, options.least)) and asked <= kinds and (not several or len(papers) >= goal) and not gain(best):
            why = "everything asked for is there"
            break
        take(best)
        pool.remove(best)
        kinds.add(info[best].kind)
        papers.add(info[best].paper_id)
    return [("package", p, k, None) for k, p in enumerate(taken, 1)] + out + [("stop", why, len(taken), None)]


def select_packages(questions: DataFrame, packages: DataFrame, routes: DataFrame, options: PackageOptions | None = None) -> DataFrame:
    """query_id, entry, name, place, detail: the chosen packages of every question in order, each slot with whether it was served, and why the choice ended.

    See rankings() for the columns. Slots always have a place each: the budget grows to their number. Questions without packages have no rows.
    """
    o = options or PackageOptions()
    asked = staged(asked_routes(questions, routes), "asked")  # one row a question
    rows = requests(rankings(asked, packages, o), asked, o)
    key = questions.schema["query_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["query_id"].iloc[0], *r) for r in _choose(pdf, o)], columns=["query_id", "entry", "name", "place", "detail"]).astype({"place": "Int64"})

    return rows.groupBy("query_id").applyInPandas(run, f"query_id {key}, entry string, name string, place long, detail string")


def context_records(selected: DataFrame, members: DataFrame, chars: int) -> DataFrame:
    """query_id, place, package_id, record_id: records of the selected packages (query_id, package_id, place) in order, each once, whole packages only.

    A package whose new records pass the limit together with what is there is left out, later ones may follow; the
    first one stays whatever its size; 0: no limit. members: package_id, record_id, position, size.
    """
    rows = selected.join(members, "package_id")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "place", "package_id", "record_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, seen, out = 0, set(), []
        for _, own in pdf.sort_values(["place", "position"], kind="stable").groupby("place", sort=True):
            new = own[~own["record_id"].isin(seen)].drop_duplicates("record_id")
            size = int(new["size"].sum())
            if chars > 0 and seen and used + size > chars:
                continue
            used += size
            seen |= set(new["record_id"])
            out.append(new)
        return pd.concat(out)[["query_id", "place", "package_id", "record_id"]]

    return rows.groupBy("query_id").applyInPandas(run, schema)
