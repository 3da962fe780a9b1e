"""Windows around evidence, and relations that can be read from them without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import staged
from .grounding import flat
from .scoring import rank_by

# What makes a question one about hardware or a comparison, and how texts say so.
HARDWARE = ("hardware", "gpu", "cpu", "tpu", "configure", "configuration", "compute")
COMPARISON = ("outperform", "compare", "difference", "better", "higher", "how", "much")
DEVICE = r"(?i)\b(?:run|ran|executed|conducted)\s+on\s+([^.;]*(?:GPU|CPU|TPU)[^.;]*)"
ORDINAL = r"(?i)\b(\d+)(?:st|nd|rd|th)\s+reference\b"
SETTING = r"500\s*(?:→|->)\s*1(?!\d)"


def cells(line: Column) -> Column:
    """The cells of a line of a pipe table."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def best_sentence(text: Column, terms: Column, limit: int) -> Column:
    """The sentence of a text that shares most terms, then holds most numbers and names, then is shortest; the text itself without sentences of twelve characters."""
    parts = F.filter(F.transform(T.sentences(text), lambda s: T.clip(s, limit)), lambda s: F.length(s) >= 12)
    facts = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"[-+]?\d+(?:\.\d+)?"), 0)) + F.size(F.regexp_extract_all(s, F.lit(T.METHOD), 0))
    score = lambda parts: F.transform(parts, lambda s, i: F.struct(F.size(F.array_intersect(terms, F.array_distinct(T.tokens(s)))).alias("shared"), facts(s).alias("facts"), (-F.length(s)).alias("short"), (-i).alias("first"), s.alias("s")))
    return T.bound(parts, lambda p: F.coalesce(F.when(F.size(p) == 1, F.get(p, F.lit(0))).otherwise(F.array_max(score(p))["s"]), T.clip(text, limit)))


def table_lines(text: Column, terms: Column, k: int = 4) -> Column:
    """The first four lines of a table, and of the others the k that share most terms, earlier ones first among equals; in their order."""
    lines = F.filter(F.transform(F.split(T.text_of(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    score = lambda rest: F.transform(rest, lambda x, i: F.struct((8 * F.size(F.array_intersect(terms, F.array_distinct(T.tokens(x)))) + 3 * x.rlike(r"(?i)\b(?:ours|icae|baseline)\b").cast("int") + 5 * x.rlike(SETTING).cast("int")).alias("score"), (-i).alias("at"), x.alias("x")))
    best = lambda rest: F.slice(F.sort_array(score(rest), asc=False), 1, k)
    return T.bound(lines, lambda v: F.concat(F.slice(v, 1, 4), F.transform(F.array_sort(best(F.slice(v, 5, F.greatest(F.size(v), F.lit(1)))), lambda a, b: b["at"] - a["at"]), lambda s: s["x"])))


def windows(anchors: DataFrame, catalog: DataFrame, neighbours: DataFrame, questions: DataFrame, *, limit: int = 520) -> DataFrame:
    """query_id, window_id, anchor_ref, reasons, support_refs, source_type, anchor_quote, neighbour_quotes, lines: a window for each anchor.

    anchors: query_id, place, evidence_ref, reason (an anchor may have several); catalog: query_id, evidence_ref,
    source_type, text; neighbours: query_id, anchor_ref, place, evidence_ref. A window quotes its anchor and neighbours by
    their best sentence, and a table by its schema lines and those that the question asks for. Unknown refs are skipped.
    """
    q = questions.select("query_id", F.array_distinct(T.tokens(F.col("question"))).alias("terms"))
    held = catalog.select("query_id", "evidence_ref", "source_type", "text").join(q, "query_id").withColumn("quote", best_sentence(F.col("text"), F.col("terms"), limit))
    held = staged(held, "quotes")  # anchors and neighbours quote the same records
    once = anchors.groupBy("query_id", "evidence_ref").agg(F.min("place").alias("place"), F.transform(F.array_sort(F.collect_set(F.struct("place", "reason"))), lambda x: x["reason"]).alias("reasons"))
    own = once.join(held, ["query_id", "evidence_ref"])
    near = neighbours.where("anchor_ref <> evidence_ref").join(held.select("query_id", "evidence_ref", "quote"), ["query_id", "evidence_ref"])
    near = near.groupBy("query_id", F.col("anchor_ref")).agg(F.array_sort(F.collect_list(F.struct("place", "evidence_ref", "quote"))).alias("n"))
    near = near.select("query_id", F.col("anchor_ref").alias("evidence_ref"), "n")
    rows = own.join(near, ["query_id", "evidence_ref"], "left")
    rows = rows.withColumn("n", F.coalesce("n", F.array().cast(near.schema["n"].dataType)))
    lines = F.when(F.col("source_type") == "table", table_lines(F.col("text"), F.col("terms")))
    return rows.select(
        "query_id", F.format_string("W%03d", rank_by(["query_id"], F.asc("place"), F.asc("evidence_ref"))).alias("window_id"), F.col("evidence_ref").alias("anchor_ref"), F.array_distinct("reasons").alias("reasons"),
        F.concat(F.array("evidence_ref"), F.transform("n", lambda x: x["evidence_ref"])).alias("support_refs"), "source_type", F.col("quote").alias("anchor_quote"), F.transform("n", lambda x: x["quote"]).alias("neighbour_quotes"), lines.alias("lines"),
    )


def citation_relations(windows: DataFrame, catalog: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, window_id, subject, predicate, object: the first author of the reference a question asks for by its number.

    catalog: query_id, evidence_ref, paper_id, cited (its number), text; questions: query_id, question, papers (array of those
    it names; empty: any).
    """
    q = questions.where(F.col("question").rlike(ORDINAL) & F.col("question").rlike(r"(?i)\bfirst\s+author\b")).select("query_id", F.regexp_extract("question", ORDINAL, 1).alias("asked"), "papers")
    rows = windows.where("source_type = 'citation_context'").select("query_id", "window_id", F.col("anchor_ref").alias("evidence_ref")).join(catalog, ["query_id", "evidence_ref"]).join(q, "query_id")
    rows = rows.where((F.col("cited").cast("string") == F.col("asked")) & ((F.size("papers") == 0) | F.array_contains("papers", F.col("paper_id"))))
    author = F.trim(F.regexp_extract(F.trim(F.regexp_replace(T.text_of(F.col("text")), r"\s+", " ")), "^([^,]*)", 1))
    rows = rows.select("query_id", "window_id", F.concat(F.lit("Reference "), "asked").alias("subject"), F.lit("cites").alias("predicate"), author.alias("object"))
    return rows.where((F.length("object") >= 2) & F.col("object").rlike("[A-Za-z]"))


def hardware_relations(windows: DataFrame, catalog: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, window_id, subject, predicate, object, quote: the device that a text says experiments ran on, for questions that ask for hardware."""
    q = questions.where(F.arrays_overlap(T.tokens(F.col("question")), F.array(*[F.lit(t) for t in HARDWARE]))).select("query_id")
    rows = windows.where("source_type = 'text_span'").select("query_id", "window_id", F.col("anchor_ref").alias("evidence_ref")).join(q, "query_id").join(catalog.select("query_id", "evidence_ref", "text"), ["query_id", "evidence_ref"])
    source = F.trim(F.regexp_replace(T.text_of(F.col("text")), r"\s+", " "))
    device = F.trim(F.regexp_extract(source, DEVICE, 1))
    quote = F.coalesce(F.get(F.filter(T.sentences(source), lambda s: F.contains(s, device)), F.lit(0)), source)
    return rows.where(device != "").select("query_id", "window_id", F.lit("experiments").alias("subject"), F.lit("uses").alias("predicate"), device.alias("object"), quote.alias("quote"))


def table_relations(windows: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, window_id, dataset, metric, ours, baseline, delta: a comparison that a table window states whole.

    The window's lines must hold the header, a metric line as wide, a line of our method and one of the baseline in the
    same setting, and below that an absolute delta; the column is the one whose header (four times) and metric share
    most words with the question, leftmost first, and must share some of both.
    """
    q = questions.select("query_id", F.array_distinct(T.tokens(F.col("question"))).alias("terms")).where(F.arrays_overlap("terms", F.array(*[F.lit(t) for t in COMPARISON])))
    rows = windows.where("source_type = 'table'").select("query_id", "window_id", F.filter("lines", lambda x: F.ltrim(x).startswith("|")).alias("lines")).where(F.size("lines") >= 5).join(q, "query_id")
    first = lambda a, f: F.get(F.filter(a, f), F.lit(0))
    rows = rows.withColumn("header", cells(F.get("lines", F.lit(0)))).withColumn("metric", cells(first("lines", lambda x: x.rlike(r"(?i)\b(?:metric|metrices)\b"))))
    rows = rows.where(F.size("metric") == F.size("header"))
    shared = lambda c: F.size(F.array_intersect(F.col("terms"), F.array_distinct(T.tokens(c))))
    score = F.transform(F.arrays_zip("header", "metric"), lambda x, i: F.struct((4 * shared(x["header"]) + shared(x["metric"])).alias("score"), (-i).alias("at"), shared(x["header"]).alias("h"), shared(x["metric"]).alias("m")))
    rows = rows.withColumn("best", F.array_max(score)).where("best.h > 0 and best.m > 0").withColumn("column", -F.col("best.at"))
    ours = first("lines", lambda x: x.rlike(r"(?i)\b(?:ours|our method)\b") & x.rlike(SETTING))
    at = F.array_min(F.transform("lines", lambda x, i: F.when(x.rlike(r"(?i)\b(?:icae|baseline)\b") & x.rlike(SETTING), i)))
    rows = rows.withColumn("ours", ours).withColumn("at", at).where("ours is not null and at is not null")
    below = F.slice("lines", F.col("at") + 2, F.size("lines"))
    rows = rows.withColumn("delta", first(below, lambda x: x.rlike(r"(?i)\babsolute\b|∆")))
    cell = lambda line: F.get(cells(line), F.col("column"))
    rows = rows.select("query_id", "window_id", F.get("header", F.col("column")).alias("dataset"), F.get("metric", F.col("column")).alias("metric"), cell(F.col("ours")).alias("ours"), cell(F.get("lines", F.col("at"))).alias("baseline"), cell(F.col("delta")).alias("delta"))
    return rows.where(F.col("ours").rlike(r"\d") & F.col("baseline").rlike(r"\d") & F.col("delta").rlike(r"\d"))


def expansions(decisions: DataFrame, triples: DataFrame, windows: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, level, triple_id, window_id, refs, text: what a sufficiency decision wants to see in full, each once.

    decisions: query_id, level (1 or 0), triple_id; triples: query_id, triple_id, windows, refs (arrays). Level 1 shows a
    triple's windows, level 0 the records their anchors are, or without windows the triple's own.
    """
    t = decisions.join(triples, ["query_id", "triple_id"]).distinct()
    w = windows.select("query_id", "window_id", "anchor_ref", "support_refs", "anchor_quote")
    linked = t.select("query_id", "level", "triple_id", F.explode("windows").alias("window_id")).join(w, ["query_id", "window_id"])
    one = linked.where("level = 1").select("query_id", "level", "triple_id", "window_id", F.col("support_refs").alias("refs"), T.clip(F.col("anchor_quote"), 620).alias("text"))
    anchors = linked.where("level = 0").select("query_id", "triple_id", F.col("anchor_ref").alias("ref"))
    own = t.where("level = 0").join(anchors.select("query_id", "triple_id").distinct(), ["query_id", "triple_id"], "left_anti").select("query_id", "triple_id", F.explode("refs").alias("ref"))
    zero = anchors.unionByName(own).distinct().join(catalog.select("query_id", F.col("evidence_ref").alias("ref"), "text"), ["query_id", "ref"])
    zero = zero.select("query_id", F.lit(0).alias("level"), "triple_id", F.lit(None).cast("string").alias("window_id"), F.array("ref").alias("refs"), T.clip(F.col("text"), 1600).alias("text"))
    return one.unionByName(zero).distinct()
