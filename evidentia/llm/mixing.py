"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow routes the patterns' tokens
to the sources' quotas; each further round of a pattern's tokens costs more than the last (convex costs), so repeats
are spread as evenly as quotas allow. Then documents are picked by a seeded digest until each flow is met.

Sources, targets and patterns that overlap with no other are worked on as tables. Only overlapping patterns, their
sums and quotas reach the driver.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .common import at_most, drop_written, materialize, word_count

#: Buckets of the seeded digest per pattern; only the bucket in which a quota ends is sorted.
BUCKETS = 4096
#: More overlapping patterns than this are refused with an error: their flow is solved on the driver.
MAX_PATTERNS = 100_000
#: Up to so many rows of a table by pattern or source are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Stands for a null source.
NULL = "\x00"
#: Stands for any source of a pattern.
ANY = "\x01"
_UNHASHED = (T.MapType, T.VariantType, T.StructType, T.ArrayType)


def rounds_of(total: float, once: float) -> list[float]:
    """Widths of the cost levels of a pattern, in tokens: four rounds of its distinct tokens, then blocks that double.

    All patterns have the same levels, and a token of a level costs the same in each, more than one of the level before.
    """
    widths, width, left = [], 1.0, total / once
    while left > 0:
        widths.append(min(width, left) * once)
        left -= width
        width = 1.0 if len(widths) < 4 else width * 2
    return widths


class _Network:
    """Maximum flow by level graphs, with capacities that may be raised between calls."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def push(self, start: int, end: int) -> None:
        while True:
            depth = {start: 0}
            queue = deque([start])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.left[e] and self.to[e] not in depth:
                        depth[self.to[e]] = depth[a] + 1
                        queue.append(self.to[e])
            if end not in depth:
                return
            turn = [0] * len(self.out)
            path: list[int] = []
            node = start
            while True:
                if node == end:
                    amount = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= amount
                        self.left[e ^ 1] += amount
                    path, node = [], start
                elif turn[node] < len(self.out[node]):
                    e = self.out[node][turn[node]]
                    if self.left[e] and depth.get(self.to[e]) == depth[node] + 1:
                        path.append(e)
                        node = self.to[e]
                    else:
                        turn[node] += 1
                elif path:
                    node = self.to[path.pop() ^ 1]
                    turn[node] += 1
                else:
                    break


def min_cost_flow(patterns: dict[tuple, float], routes: dict[tuple, int], quotas: dict) -> dict[tuple, int]:
    """Tokens by route, {(pattern, source): tokens}: as many as quotas allow, at the least sum of costs.

    patterns: {pattern: its distinct tokens}; routes: {(pattern, source): most tokens}; quotas: {source: tokens}.
    Costs arise only where tokens leave a pattern, and are alike for all tokens of a level. What can leave the patterns
    at once is a polymatroid, so filling the levels one after the other, each by a maximum flow on top of what flows
    already, gives the least cost of a maximum flow.
    """
    names = {s: k for k, s in enumerate(sorted({s for _, s in routes}, key=str))}
    order = sorted((p for p in patterns if patterns[p] > 0), key=str)
    place = {p: 2 + len(names) + k for k, p in enumerate(order)}
    net = _Network(2 + len(names) + len(order))
    for s, k in names.items():
        net.arc(2 + k, 1, int(quotas.get(s, 0) + 0.5))
    total = dict.fromkeys(order, 0)
    arcs = {}
    for p, s in sorted(routes, key=str):
        if p in place:
            arcs[p, s] = net.arc(place[p], 2 + names[s], routes[p, s])
            total[p] += routes[p, s]
    entry = {p: net.arc(0, place[p], 0) for p in order}
    levels = {p: rounds_of(total[p], patterns[p]) for p in order}
    given = dict.fromkeys(order, 0)
    for level in range(max(map(len, levels.values()), default=0)):
        for p in order:
            if level < len(levels[p]):
                upto = total[p] if level == len(levels[p]) - 1 else int(sum(levels[p][: level + 1]))
                net.left[entry[p]] += upto - given[p]
                given[p] = upto
        net.push(0, 1)
    return {key: net.left[e ^ 1] for key, e in arcs.items()}


def _digest(seed: int, tie: Column) -> Column:
    """A number in [0, 2**52) from the seed and the document, the same in any engine with MD5; without an id, from the row's hash."""
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("row "), tie.cast("string")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long")


def _name(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(NULL))


def _places(rows: DataFrame, per: DataFrame, wanted: DataFrame) -> DataFrame:
    """_pattern, _cell, rounds, edge (bucket), cut (key of the last document), equal (how many documents of that key), met (tokens).

    rows: _pattern, _cell, _bucket, _u, _size, _tie; per: tokens by bucket; wanted: tokens by cell.
    """
    by = ["_pattern", "_cell"]
    plan = wanted.where("tokens > 0").select(*by, F.expr("wanted div tokens").alias("rounds"), F.expr("wanted % tokens").alias("rest"), "tokens")
    plan = materialize(plan, "rounds")
    before = F.sum("tokens").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("tokens")
    reach = per.withColumn("before", before).join(at_most(plan.drop("tokens"), BROADCAST_ROWS), by).where("rest > 0 and before < rest")
    edge = reach.groupBy(*by).agg(F.max(F.struct("_bucket", "before", "rest")).alias("edge"))
    edge = materialize(edge.select(*by, F.col("edge._bucket").alias("edge"), F.col("edge.before").alias("before"), F.col("edge.rest").alias("rest")), "edges")
    last = rows.join(at_most(edge, BROADCAST_ROWS), by).where("_bucket = edge")
    last = last.groupBy(*by, "_u", "_size", "_tie", "before", "rest").agg(F.count("*").alias("equal"))  # equal rows are one key
    upto = F.col("before") + F.sum(F.col("_size") * F.col("equal")).over(W.partitionBy(*by).orderBy("_u", "_size", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = last.withColumn("own", F.col("_size") * F.col("equal")).withColumn("start", upto - F.col("_size") * F.col("equal"))
    # as many of the equal rows as come nearest to the rest
    room = F.col("rest") - F.col("start")
    some = F.when(F.col("_size") == 0, F.when(room >= 0, F.col("equal")).otherwise(0)).otherwise(F.expr("(rest - start) div _size") + (2 * (room % F.col("_size")) > F.col("_size")).cast("int"))
    last = last.withColumn("some", F.least(F.col("equal"), F.greatest(F.lit(0), some))).where("some > 0")
    cut = last.groupBy(*by).agg(F.max(F.struct("_u", "_size", "_tie", "some", "start", "equal")).alias("cut"))
    got = F.coalesce(F.col("cut.start") + F.col("cut.some") * F.col("cut._size"), F.col("before"), F.lit(0))
    key = F.when(F.col("cut").isNotNull(), F.struct("cut._u", "cut._size", "cut._tie"))
    found = plan.join(edge.drop("rest"), by, "left").join(cut, by, "left")
    return materialize(found.select(*by, "rounds", "edge", key.alias("cut"), F.col("cut.some").alias("some"), F.col("cut.equal").alias("equal"), (F.col("rounds") * F.col("tokens") + got).alias("met")), "places")


def mix(docs: DataFrame, sources: Column, quotas: DataFrame, *, own: Column | None = None, once: Column | None = None, size: Column | None = None, doc_id: str = "doc_id", seed: int = 1, copies: int = 3) -> DataFrame:
    """docs with _size, _pattern and _copies: how many times the mix takes each document (0 to copies).

    sources: array of the sources of a document, nulls as they are; quotas: source, quota (tokens). A document counts
    for any source of its pattern, or for `own` alone where that is given; `once` is its part of the pattern's distinct
    tokens (all of them, unless the rows repeat texts). A cell (a pattern, with its own source) whose flow is r rounds
    of all its tokens and a rest takes every document r times and, by the seeded digest, once more as many as come
    nearest to the rest; what shared patterns give too much or too little is made good by the patterns of one source. Ties of the digest (equal or null ids) go by size and a
    hash of the row's plain columns; of rows that are equal in all of that, as many are taken as fit. Names that begin
    with an underscore are this function's own. A document without words is taken with its digest's place. Nothing is
    sorted but the one bucket in which a rest ends; more than MAX_PATTERNS overlapping patterns are an error.
    """
    spark = docs.sparkSession
    by = ["_pattern", "_cell"]
    pattern = F.array_sort(F.array_distinct(F.transform(sources, _name)))
    rows = docs.withColumn("_size", (word_count("text") if size is None else size).cast("long")).withColumn("_pattern", pattern).withColumn("_cell", F.lit(ANY) if own is None else _name(own)).withColumn("_id", F.col(doc_id))
    rows = rows.withColumn("_once", (F.col("_size") if once is None else once).cast("double"))
    rows = rows.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, _UNHASHED)])).withColumn("_u", _digest(seed, F.col("_tie"))).withColumn("_bucket", F.shiftright("_u", 40).cast("int"))
    narrow = materialize(rows.select(*by, "_bucket", "_u", "_size", "_tie", "_once"), "mixed")
    per = materialize(narrow.groupBy(*by, "_bucket").agg(F.sum("_size").alias("tokens"), F.sum("_once").alias("once")), "buckets")
    cells = materialize(per.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.sum("once").alias("once")), "cells")
    quotas = quotas.select(_name(F.col("source")).alias("_source"), F.floor(F.col("quota") + 0.5).cast("long").alias("quota"))

    alone = F.size("_pattern") == 1
    shared = cells.where(~alone).select(F.explode("_pattern").alias("_source")).distinct()
    cells = cells.withColumn("_source", F.when(alone, F.col("_pattern")[0]))
    direct = cells.where(alone).join(at_most(shared, BROADCAST_ROWS), "_source", "left_anti").join(quotas, "_source", "left")
    direct = direct.select(*by, "tokens", F.least(F.coalesce("quota", F.lit(0)), copies * F.col("tokens")).alias("wanted"))
    tied = cells.where(~alone).unionByName(cells.where(alone).join(at_most(shared, BROADCAST_ROWS), "_source", "left_semi").select(cells.columns))
    found = tied.limit(MAX_PATTERNS + 1).collect()  # patterns that overlap, with their sums
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} overlapping membership patterns")
    known = {r["_source"]: r["quota"] for r in quotas.join(F.broadcast(shared), "_source").collect()} if found else {}
    once_of, routes, size_of = {}, {}, {}
    for r in found:
        p = tuple(r["_pattern"])
        once_of[p] = once_of.get(p, 0.0) + r["once"]
        size_of[p, r["_cell"]] = int(r["tokens"])
        for s in p if r["_cell"] == ANY else [r["_cell"]]:
            routes[p, s] = copies * int(r["tokens"])
    flow = min_cost_flow(once_of, routes, known)
    schema = "_pattern array<string>, _cell string, tokens long, wanted long"
    table = lambda keep: spark.createDataFrame([(list(p), c, n, min(copies * n, sum(flow.get((p, s), 0) for s in p) if c == ANY else flow.get((p, c), 0))) for (p, c), n in size_of.items() if keep(p)], schema)
    places = _places(narrow, per, table(lambda p: len(p) > 1)) if found else None
    if places is not None and own is not None:  # the shared cells come near their flows; cells of one source take what is left of the quota
        got = places.groupBy(F.col("_cell").alias("_source")).agg(F.sum("met").alias("met"))
        rest = table(lambda p: len(p) == 1).withColumn("_source", F.col("_cell")).join(quotas, "_source", "left").join(got, "_source", "left")
        left = F.coalesce("quota", F.lit(0)) - F.coalesce("met", F.lit(0))
        direct = direct.unionByName(rest.select(*by, "tokens", F.least(F.greatest(left, F.lit(0)), copies * F.col("tokens")).alias("wanted")))
    elif found:
        direct = direct.unionByName(table(lambda p: len(p) == 1))
    single = _places(narrow, per, direct)
    places = at_most(materialize(single if places is None else places.unionByName(single), "plan"), BROADCAST_ROWS)
    rows = rows.join(places, by, "left")
    key = F.struct("_u", "_size", "_tie")
    inside = (F.col("_bucket") < F.col("edge")) | ((F.col("_bucket") == F.col("edge")) & (key <= F.col("cut")))
    partly = F.coalesce((key == F.col("cut")) & (F.col("some") < F.col("equal")), F.lit(False))
    rows = rows.withColumn("_copies", (F.coalesce("rounds", F.lit(0)) + F.coalesce(inside, F.lit(False)).cast("int")).cast("int"))
    if not places.where("some < equal").isEmpty():  # of equal rows, the first `some`
        number = F.row_number().over(W.partitionBy(*by).orderBy("_u"))
        first = rows.where(partly).withColumn("_copies", (F.col("_copies") - (number > F.col("some")).cast("int")).cast("int"))
        rows = rows.where(~partly).unionByName(first)
    for t in (per, narrow):
        drop_written(t)
    return rows.drop("_id", "_u", "_bucket", "_tie", "_once", "_cell", "rounds", "edge", "cut", "some", "equal", "met")


def memberships(docs: DataFrame, *, source: str = "source", text: str = "text") -> DataFrame:
    """docs with _members, the sources that hold an equal text (its own among them), and _times, in how many rows it stands.

    Rows are counted by (text, source) before anything meets by text; rows of texts that only one source holds have
    _times 1. The table of texts of several sources meets the rows in slices, so that one very common text is no hot key.
    """
    key = F.unhex(F.substring(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256), 1, 32))
    held = docs.select(key.alias("_key"), _name(F.col(source)).alias("s")).groupBy("_key", "s").agg(F.count("*").alias("n"))
    several = materialize(held.groupBy("_key").agg(F.array_sort(F.collect_list("s")).alias("_members"), F.sum("n").alias("_times")).where(F.size("_members") > 1), "members")
    slices = 16
    if several.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        wide = several.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        rows = docs.withColumn("_key", key).withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")).join(wide, ["_key", "_slice"], "left").drop("_slice")
    else:
        rows = docs.withColumn("_key", key).join(F.broadcast(several), "_key", "left")
    return rows.withColumn("_members", F.coalesce("_members", F.array(_name(F.col(source))))).withColumn("_times", F.coalesce("_times", F.lit(1))).drop("_key")


def source_targets(docs: DataFrame, *, source: str = "source", size: Column | None = None, cycle: tuple[int, ...] = (1, 2, 3), copies: int = 3, part_rows: int = 1_000_000) -> DataFrame:
    """source, size, weight, target by source.

    Sources by code point, null last, weigh as cycle says, repeating. All sizes are shared by weight; a target stops at
    copies times its source's size, and the excess is shared again until none is above. Sources are numbered within ranges of them, so any number will do.
    """
    sizes = materialize(docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.coalesce(F.sum(word_count("text") if size is None else size), F.lit(0)).cast("long").alias("size")), "source-sizes")
    by = [F.col("source").isNull(), F.col("source")]
    ranges = materialize(sizes.repartitionByRange(1 + sizes.count() // part_rows, *by).withColumn("part", F.spark_partition_id()), "source-ranges")
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))  # one row per range
    number = F.row_number().over(W.partitionBy("part").orderBy(*by)) - 1 + F.col("before")
    weight = F.get(F.array(*[F.lit(w) for w in cycle]), (number % len(cycle)).cast("int"))
    ranked = materialize(ranges.join(F.broadcast(before), "part").select("source", "size", weight.cast("long").alias("weight")), "source-weights")
    sums = lambda c: ranked.where(c).agg(F.sum("size"), F.sum("weight"), F.count("*")).first()
    total = int(sums(F.lit(True))[0] or 0)
    left, heavy, known, capped = total, int(sums(F.lit(True))[1] or 0), -1, F.lit(False)
    while True:  # each time round, more sources reach their limit, or it ends
        capped = copies * F.col("size").cast("decimal(38,0)") * heavy <= F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(38,0)") if heavy else F.lit(True)
        n, w, count = sums(capped)
        if count == known:
            break
        known, left, heavy = count, total - copies * int(n or 0), int(sums(F.lit(True))[1] or 0) - int(w or 0)
    shared = F.lit(float(left)) * F.col("weight") / F.lit(float(heavy or 1))
    return ranked.withColumn("target", F.when(capped, (copies * F.col("size")).cast("double")).otherwise(shared))


def take_mix(docs: DataFrame, *, seed: int = 1) -> DataFrame:
    """The rows of docs as often as a mix of their sources to the weights 1, 2, 3, ... takes them; all columns as they are.

    A text that stands in several sources is one document of all of them: its rows are taken for their own sources, and its repeats there count together.
    """
    quotas = source_targets(docs).select("source", F.col("target").alias("quota"))
    rows = memberships(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text"))
    rows = rows.withColumn("_words", word_count("text")).drop("text")
    mixed = mix(rows, F.col("_members"), quotas, own=F.col("source"), size=F.col("_words"), once=F.col("_words") / F.col("_times"), seed=seed).where("_copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
