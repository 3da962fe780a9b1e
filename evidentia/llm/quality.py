"""Quality rules: word and repetition rules on each text, and the frequency of lines across the documents of a host.

Everything is DataFrame expressions. Lines are hashed after normalising; a line that too many distinct texts of a host
hold is boilerplate and goes; a document of which too little is left is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, materialize, where_after, words

#: Up to so many boilerplate lines of all hosts together are broadcast, 8 bytes each; beyond, hosts are joined by shuffle.
BROADCAST_LINES = 200_000
#: Beyond that, each host's lines are copied so often, so that no task holds all documents of one host.
SLICES = 32
#: A host's lines lie in so many lists by their hash, so that a line is looked up in a short one.
LISTS = 64
_NO_HOST = "<null>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(w: Column) -> Column:
    """Words that lie in three-word windows found twice or more, of an array of words.

    Windows are compared by 64-bit hashes. A text with few different repeats looks them up directly, others sort
    their windows once.
    """

    def positions(h: Column, repeats: Column) -> Column:
        few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(repeats, x), i)), lambda i: i.isNotNull())
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        many = _let(ranked, lambda s: F.transform(F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()), lambda i: i))
        return F.when(F.size(repeats) <= 32, few).otherwise(many)

    def covered(h: Column, repeats: Column) -> Column:
        spread = F.flatten(F.transform(positions(h, repeats), lambda i: F.array(i, i + 1, i + 2)))
        return F.when(F.size(repeats) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(spread)))

    def repeats(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x)))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    found = _let(windows, lambda h: _let(_let(F.sort_array(h), repeats), lambda r: covered(h, r)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(found).cast("long")


def _lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case with single spaces."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def boilerplate(docs: DataFrame, *, text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.1) -> DataFrame:
    """host, lines (lists of hashes, by hash): lines that more than max(min_docs, share of the host's texts) different texts of it hold.

    Copies of a text count once, so that copies alone make no line frequent. A null host is a host of its own. Rows
    are counted by (host, line, text) before anything meets by line, so a very frequent line is no hot key.
    """
    rows = docs.select(F.coalesce(F.col(host).cast("string"), F.lit(_NO_HOST)).alias("host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("host", F.xxhash64("text").alias("t"), F.array_distinct(F.transform(_lines(F.col("text")), line_hash)).alias("lines"))
    texts = rows.select("host", "t").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counts = rows.select("host", "t", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    over = materialize(counts.join(texts, "host").where(F.col("n") > F.col("texts") * share).select("host", "line"), "frequent-lines")
    lists = over.groupBy("host", _list_of(F.col("line")).alias("k")).agg(F.sort_array(F.collect_list("line")).alias("own"))
    every = over.select("host").distinct().select("host", F.explode(F.sequence(F.lit(0), F.lit(LISTS - 1))).alias("k"))
    lists = every.join(lists, ["host", "k"], "left").select("host", F.struct("k", F.coalesce("own", F.array().cast("array<long>")).alias("own")).alias("x"))
    return lists.groupBy("host").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["own"]).alias("lines"))


def _list_of(line: Column) -> Column:
    return F.pmod(line, F.lit(LISTS)).cast("int")


def with_verdicts(docs: DataFrame, *, text: str = "text", host: str = "source", min_words: int = 50, repeat_percent: int = 50, least_percent: int = 30, min_docs: int = 20, share: float = 0.1) -> DataFrame:
    """docs with the struct column `quality`: the rules' figures, base_failed, kept, removed_words, clean_text.

    kept is false if base_failed, or if fewer than least_percent of the words are left without boilerplate lines.
    clean_text is the text without those lines (null text: null). Null texts have no words, so they fail; repeated
    rows are judged alike; a column of docs named `quality` is replaced. Empty table: no rows.
    """
    lines = materialize(boilerplate(docs, text=text, host=host, min_docs=min_docs, share=share), "lines")
    size = lines.agg(F.sum(F.aggregate("lines", F.lit(0), lambda n, x: n + F.size(x)))).first()[0] or 0
    side = lines.select(F.col("host").alias("__ev_host"), F.col("lines").alias("__ev_boilerplate"))
    rows = docs.withColumn("__ev_key", F.coalesce(F.col(host).cast("string"), F.lit(_NO_HOST)))
    same = F.col("__ev_key") == F.col("__ev_host")
    if size <= BROADCAST_LINES:
        side = F.broadcast(side)
    else:
        side = side.withColumn("__ev_copy", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        rows = rows.withColumn("__ev_slice", F.pmod(F.xxhash64(text), F.lit(SLICES)).cast("int"))
        same &= F.col("__ev_slice") == F.col("__ev_copy")
    rows = rows.join(side, same, "left").drop("__ev_host", "__ev_key", "__ev_copy", "__ev_slice")
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def figures(w: Column) -> Column:
        held = _lines(raw)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
            (F.length(raw) - F.length(F.regexp_replace(raw, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            _let(held, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    frequent = lambda x: _let(line_hash(x), lambda h: F.array_contains(F.get("__ev_boilerplate", _list_of(h)), h))
    gone = F.filter(F.split(raw, "\n"), frequent)
    left = F.filter(F.split(raw, "\n"), lambda x: ~frequent(x))
    rows = rows.withColumn("__ev_figures", _let(words(raw), figures))
    rows = rows.withColumn("__ev_removed", F.when(F.col("__ev_boilerplate").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(gone, F.lit(0).cast("long"), lambda n, x: n + F.size(words(x)))))
    f = lambda c: F.col(f"__ev_figures.{c}")
    failed = (f("n_words") < min_words) | (100 * f("n_repeat_words") > repeat_percent * f("n_words"))
    enough = 100 * (f("n_words") - F.col("__ev_removed")) >= least_percent * f("n_words")
    clean = F.when((F.col("__ev_removed") == 0) | F.col(text).isNull(), F.col(text).cast("string")).otherwise(F.array_join(left, "\n"))
    out = F.struct(*[f(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), (~failed & enough).alias("kept"), F.col("__ev_removed").alias("removed_words"), clean.alias("clean_text"))
    return rows.withColumn("quality", out).drop("__ev_figures", "__ev_removed", "__ev_boilerplate")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass, with boilerplate lines taken out of their texts; all columns as they were named."""
    text = options.get("text", "text")
    plain = docs.columns
    rows = with_verdicts(docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("row"), F.col(text), F.col(options.get("host", "source"))), **options)
    rows = where_after(rows, F.col("quality.kept"))
    clean = F.col("quality.clean_text")
    return rows.select(*[(clean if c == text else F.length(clean).cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row")[c]).alias(c) for c in plain])
