"""Near-duplicate classes of documents by BagMinHash over multisets of word shingles.

Weights are counts. The levels of an element are cut into dyadic intervals; each interval has one Poisson process,
shared by all documents that hold the element, whose points carry an arrival time, a signature component and a level.
A document keeps the points at levels its count reaches; the earliest point of a component is its signature. Two
documents agree in a component with a probability equal to their weighted Jaccard similarity.

Bands of signature components give buckets. Within a bucket nobody meets everybody: all members meet the bucket's
leader, members that no link has joined to it meet the next leader, and what is still apart after that meets the
members of other classes. Every link is verified on the whole multisets, and only then counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, drop_written, materialize, release, small_batches

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: So many members of a bucket, or texts of an element, meet its leaders, or each other, in one place.
SLICE_MEMBERS = 512
#: Copies of the narrow table of those buckets that a second turn is needed for.
SLICES = 8


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each document, in a row, and their offsets. words: word hashes of all documents in a row.

    A document of fewer words than `size` has one shingle of all of them, one without words has none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    full = lengths >= size
    starts = np.repeat(offsets[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    with np.errstate(over="ignore"):
        words = words.astype(np.uint64)
        lasts = len(words) - 1
        out = np.zeros(len(starts), dtype=np.uint64)
        in_full = np.repeat(full, counts)
        for k in range(size):
            step = mix(out * np.uint64(0x100000001B3) + words[np.minimum(starts + k, lasts)] + _GOLD)
            out = np.where(in_full | (k < np.repeat(lengths, counts)), step, out) if not full.all() else step
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b].sort()
    return out, bounds


def _elements(sorted_hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each document with their counts: hash, count, document."""
    if not len(sorted_hashes):
        return sorted_hashes, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first = np.ones(len(sorted_hashes), dtype=bool)
    first[1:] = (sorted_hashes[1:] != sorted_hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return sorted_hashes[at], np.diff(np.append(at, len(sorted_hashes))), doc[at]


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(sorted_hashes: np.ndarray, bounds: np.ndarray, m: int = 120) -> np.ndarray:
    """Signatures: one row of m numbers per document; documents without shingles have zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, m), dtype=np.uint64)
    value, count, doc = _elements(sorted_hashes, bounds)
    # an interval of levels per power of two that the count reaches: [0, 1), [1, 2), [2, 4), ...
    parts = np.where(count == 1, 1, 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)) if len(count) else count
    owner = np.repeat(np.arange(len(value)), parts)
    power = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(power == 0, 0, 1 << np.maximum(power - 1, 0))
    width = np.where(power == 0, 1, low)
    with np.errstate(over="ignore"):
        seed = mix(value[owner] ^ mix((power.astype(np.uint64) + np.uint64(1)) * _GOLD))
    top, owner_doc = count[owner], doc[owner]
    weight = np.diff(bounds)
    todo, slack = weight > 0, 4.0
    while todo.any():
        horizon = np.where(todo, m / np.maximum(weight, 1) * (np.log(m) + slack), 0.0)
        live = np.flatnonzero(todo[owner_doc])
        time, step = np.zeros(len(live)), 0
        times, places, tags = [], [], []
        while len(live):
            with np.errstate(over="ignore"):
                draw = mix(seed[live] + np.uint64(3 * step + 1) * _GOLD)
                where = mix(draw + _GOLD)
                level = mix(where + _GOLD)
            time = time - np.log(_uniform(draw)) / width[live]
            keep = time <= horizon[owner_doc[live]]
            live, time, draw, where, level = live[keep], time[keep], draw[keep], where[keep], level[keep]
            reached = low[live] + (_uniform(level) * width[live]).astype(np.int64) < top[live]
            times.append(time[reached])
            places.append(owner_doc[live[reached]] * m + (where[reached] % np.uint64(m)).astype(np.int64))
            tags.append(draw[reached])
            step += 1
        times, places, tags = map(np.concatenate, (times, places, tags))
        order = np.argsort(-times, kind="stable")  # the earliest is written last
        flat, filled = np.zeros(n * m, dtype=np.uint64), np.zeros(n * m, dtype=bool)
        flat[places[order]] = tags[order]
        filled[places] = True
        done = filled.reshape(n, m).all(axis=1) & todo
        out[done] = flat.reshape(n, m)[done]
        todo, slack = todo & ~done, slack * 2
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One number per band of so many components."""
    n, m = signatures.shape
    parts = signatures[:, : m // rows * rows].reshape(n, m // rows, rows)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix(key * np.uint64(0x100000001B3) + parts[:, :, k] + _GOLD)
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted hashes; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    va, ca, _ = _elements(a, np.array([0, len(a)]))
    vb, cb, _ = _elements(b, np.array([0, len(b)]))
    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets


def word_hashes(text: str) -> F.Column:
    """Hashes of the words of a text column, hashed by the JVM."""
    return F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _sketches(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """tid, n (shingles), keys (one per band) of rows tid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                column = part.column(1)
                values, offsets = _flat(column)
                hashes, bounds = shingles(values[offsets[0] : offsets[-1]], offsets - offsets[0], size)
                keys = band_keys(bag_minhash(hashes, bounds, bands * rows), rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds).astype(np.int32)), lists], names=["tid", "n", "keys"])
        release()

    return texts.select("tid", word_hashes("text").alias("words")).mapInArrow(run, "tid binary, n int, keys array<bigint>")


def _verified(edges: DataFrame, texts: DataFrame, size: int, least: float, block: int = 512) -> DataFrame:
    """The pairs (a, b) of edges whose multisets overlap enough.

    Pairs are dealt out by b in blocks of some hundred, so that a b with very many partners is met by many tasks; each
    block holds b's text once and streams its partners past it.
    """
    spread = edges.groupBy("b").agg(F.count("*").alias("n")).select("b", F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("a", F.lit(3)), F.lit(SLICES)).cast("int")  # a b with very many partners is no hot key
    dealt = edges.withColumn("slice", part).join(spread.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), ["b", "slice"]).select("b", F.expr("cast(pmod(xxhash64(a), blocks) as int)").alias("block"), F.col("a").alias("tid"), F.lit(1).alias("part"))
    heads = spread.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("b").alias("tid"), F.lit(0).alias("part"))
    rows = dealt.unionByName(heads).join(texts, "tid").repartition("b", "block").sortWithinPartitions("b", "block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            a, b = [], []
            values, offsets = _flat(batch.column(3))
            ids, bs, parts = batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hashes, bounds = shingles(values[offsets[0] : offsets[-1]], offsets - offsets[0], size)
            for k, (tid, to, part) in enumerate(zip(ids, bs, parts, strict=True)):
                mine = hashes[bounds[k] : bounds[k + 1]]
                if part == 0:
                    leader, own = to, mine.copy()
                elif to == leader and overlap(mine, own) >= least:
                    a.append(tid)
                    b.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        release()

    return rows.select("b", "part", "tid", word_hashes("text").alias("words")).mapInArrow(run, "a binary, b binary")


def _prefix_pairs(rest: DataFrame, texts: DataFrame, size: int, least: float, often: int = 64) -> DataFrame:
    """Pairs (a, b, n, m, ra, rb) of rest (tid, n, root) that may be similar enough, of different roots; none is lost.

    A text's elements are its shingles, numbered where they repeat, in the order of how many texts hold them. Texts
    that overlap by `least` share an element within the first n - ceil(least * n) + 1 of both. A passage that very
    many texts share comes last, so that it brings together only those that hardly have more than that. Pairs that meet in an element of more than
    `often` texts alone are let through only if such elements are enough for the overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _flat(batch.column(1))
            hashes, bounds = shingles(values[offsets[0] : offsets[-1]], offsets - offsets[0], size)
            _, count, _ = _elements(hashes, bounds)
            turn = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
            with np.errstate(over="ignore"):
                own = mix(hashes + turn.astype(np.uint64) * _GOLD).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own))], names=["tid", "elements"])
        release()

    held = texts.join(rest.select("tid"), "tid", "left_semi").select("tid", word_hashes("text").alias("words")).mapInArrow(run, "tid binary, elements array<bigint>")
    single = materialize(held.select("tid", F.explode("elements").alias("e")), "elements")
    # elements that the same texts hold (those of one shared passage) are one class: h tells the set of texts
    spread = single.groupBy("e").agg(F.count("*").alias("df"), F.bit_xor(F.xxhash64("tid")).alias("h")).where("df > 1")
    # elements of one text alone come first and bring nobody together: only how many there are counts
    common = single.join(spread, "e").groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("common"))
    taken = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1 - (F.col("n") - F.size("common"))
    hot = F.size(F.filter("common", lambda x: x.df > often))
    first = rest.join(common, "tid").where(taken > 0).select("tid", "n", "root", hot.alias("hot"), F.array_distinct(F.slice("common", F.lit(1), F.greatest(taken, F.lit(0)))).alias("held"))
    first = first.select("tid", "n", "root", "hot", F.transform("held", lambda x: x["h"]).alias("held"), F.explode("held").alias("at"))
    first = first.select("tid", "n", "root", "hot", "held", F.col("at.h").alias("e"), (F.col("at.df") > often).alias("frequent"))
    # in a frequent element, only texts that consist of frequent ones to the asked part can have a partner
    first = first.where(~F.col("frequent") | (F.col("hot") >= F.col("n") * least - 1e-9))
    mixed = first.groupBy("e").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / SLICE_MEMBERS).cast("int").alias("slices")).where("low <> high").select("e", "slices")
    mixed = mixed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    firsts = materialize(first.withColumn("part", F.pmod(F.xxhash64("tid"), F.lit(SLICES)).cast("int")).join(mixed, ["e", "part"]).drop("part"), "firsts")
    drop_written(single)
    # a frequent element's texts meet each other in slices by slices
    slice_of = F.pmod(F.xxhash64("tid", F.lit(9)), F.col("slices")).cast("int")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    first = firsts.select("*", slice_of.alias("sa"), F.explode(every).alias("sb"))
    second = firsts.select("*", slice_of.alias("sb"), F.explode(every).alias("sa"))
    one = first.select(F.col("e").alias("ea"), F.col("sa").alias("pa"), F.col("sb").alias("pb"), F.col("tid").alias("a"), "n", F.col("root").alias("ra"), F.col("hot").alias("ha"), F.col("held").alias("la"), F.col("frequent"))
    two = second.select("e", "sa", "sb", F.col("tid").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"), F.col("hot").alias("hb"), F.col("held").alias("lb"))
    may = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m"))
    # texts that share no rarer element overlap in frequent ones alone, and need enough of those
    enough = F.least("ha", "hb") * (1 + least) >= (F.col("n") + F.col("m")) * least - 1e-9
    once = F.array_min(F.array_intersect("la", "lb")) == F.col("e")  # a pair meets in several frequent elements, and counts in one
    return one.join(two, (F.col("ea") == F.col("e")) & (F.col("pa") == F.col("sa")) & (F.col("pb") == F.col("sb")) & may & (~F.col("frequent") | (enough & once))).select("a", "b", "n", "m", "ra", "rb")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): tid, root (the smallest member), by alternating large and small stars.

    Each round is written to the shared folder, so nothing is computed twice and lost executors cost one round.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, seen, old = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None, None
    while True:
        pairs = both(edges)
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = materialize(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        if old is not None:
            drop_written(old)
        old = edges
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("tid"), F.col("b").alias("root"))
        seen = state


def text_classes(texts: DataFrame, **options) -> DataFrame:
    """tid, root for each text that is linked to another, of distinct texts (tid binary, text); see linked()."""
    with small_batches(texts.sparkSession):  # all that runs Python is run inside
        return linked(texts, **options)


def linked(texts: DataFrame, *, size: int = 5, least: float = 0.8, bands: int = 24, rows: int = 5, leaders: tuple[int, ...] = (1, 4)) -> DataFrame:
    """tid, root for each text that is linked to another, of distinct texts (tid binary, text).

    Two texts are linked if the weighted Jaccard similarity of their shingles is at least `least` and they agree in a
    whole band; at 0.8 a pair misses all 24 bands of 5 with a probability below 1e-4.
    """
    sketches = _sketches(texts, size, bands, rows).where("n > 0")
    sketched = materialize(sketches.dropDuplicates(["tid"]), "bands")
    member = sketched.select("tid", "n", F.posexplode("keys").alias("band", "key"))
    several = lambda own, c: own.groupBy("band", "key").agg(F.min(c).alias("low"), F.max(c).alias("high"), F.ceil(F.count("*") / SLICE_MEMBERS).cast("int").alias("slices")).where("low <> high").select("band", "key", "slices")
    member = materialize(member.join(several(member, "tid"), ["band", "key"]), "buckets")
    held = materialize(texts.join(member.select("tid").distinct(), "tid").dropDuplicates(["tid"]), "texts")
    written = [sketched, member, held]
    ratio = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")  # else the counts alone rule the pair out
    links = met = None
    left, root = member, None
    for turn in range(len(leaders) + 1):
        if turn:
            left = member.join(root, "tid", "left").select("band", "key", "tid", "n", F.coalesce("root", "tid").alias("root"))
            part = F.pmod(F.xxhash64("tid", F.lit(7)), F.lit(SLICES)).cast("int")
            apart = several(left, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
            left = materialize(left.withColumn("part", part).join(apart, ["band", "key", "part"]).drop("part"), "apart")
            written.append(left)
            if left.isEmpty():
                break
        if turn < len(leaders):
            # leaders of this turn: the smallest member of a bucket, and the first ones by digests that change from turn to turn
            own = ["tid", "n", *(["root"] if turn else [])]
            rank = lambda j: F.lit(0).cast("long") if not turn else F.col("n").cast("long") if not j else F.xxhash64("tid", F.lit(100 * turn + j))
            firsts = [F.min(F.struct(rank(j), *own)).alias(f"lead{j}") for j in range(leaders[turn])]
            lead = left.groupBy("band", "key").agg(F.max("slices").alias("slices"), *firsts).select("band", "key", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), *[f"lead{j}" for j in range(leaders[turn])])
            lead = lead.select("band", "key", "slice", F.explode(F.array_distinct(F.transform(F.array(*[f"lead{j}" for j in range(leaders[turn])]), lambda x: F.struct(*[x[c].alias(c) for c in own])))).alias("lead"))
            dealt = left.withColumn("slice", F.pmod(F.xxhash64("tid", F.lit(9)), F.col("slices")).cast("int"))
            pairs = dealt.join(lead, ["band", "key", "slice"]).select(F.col("tid").alias("a"), F.col("lead.tid").alias("b"), "n", F.col("lead.n").alias("m"), *([F.col("root").alias("ra"), F.col("lead.root").alias("rb")] if turn else []))
        else:
            pairs = _prefix_pairs(left.select("tid", "n", "root").distinct(), held, size, least)
        pairs = pairs.where(F.col("a") != F.col("b")).where(ratio)
        pairs = (pairs.where("ra <> rb") if turn else pairs).select("a", "b").distinct()
        if met is not None:
            pairs = pairs.join(met, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = materialize(_verified(pairs, held, size, least), "links")
        written += [pairs, found]
        met = pairs if met is None else met.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        root, old = components(links), root
        if old is not None:
            drop_written(old)
    for t in written:
        drop_written(t)
    return root


def near_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, class_id, tid.

    A class is a connected component of near copies; class_id is its smallest doc_id (null if all are null). Texts
    are compared as they are: case and punctuation count, white space only as a separator. Documents without words
    (null or blank texts) are in no group, and have their own doc_id as class_id. Repeated rows and equal texts are
    one text. Other columns are ignored. tid is the text's digest, null without words.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("text"))
    rows = rows.withColumn("tid", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.substring(F.sha2("text", 256), 1, 32))))
    root = text_classes(rows.where("tid is not null").select("tid", "text"), **options)
    own = rows.where("tid is not null").groupBy("tid").agg(F.min("doc_id").alias("least_id"))
    own = own.join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    ids = own.groupBy("root").agg(F.min("least_id").alias("class_id"))
    classes = own.join(ids, "root").select("tid", "class_id")
    return rows.select("doc_id", "tid").join(classes, "tid", "left").select("doc_id", F.coalesce("class_id", F.when(F.col("tid").isNull(), F.col("doc_id"))).alias("class_id"), "tid")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each class the row with the smallest doc_id, all columns as they are.

    Rows without words stay. A row with a null doc_id stands for its class only if all have null.
    """
    columns = docs.columns
    plain = [F.col("row")[c] for c in columns if not re.search("map<|variant", docs.schema[c].dataType.simpleString())]
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), content.alias("text"))
    rows = rows.select("row", "id", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.substring(F.sha2("text", 256), 1, 32))).alias("tid"), F.xxhash64(*plain).alias("sum"), "text")
    root = text_classes(rows.where("tid is not null").select("tid", "text"), **options)
    first = F.min(F.struct(F.col("id").isNull().alias("void"), "id", "tid", "sum")).alias("first")
    own = rows.where("tid is not null").groupBy("tid").agg(first).join(root, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    kept = own.groupBy("root").agg(F.min("first").alias("first")).select("first.tid", F.col("first.id").alias("kept_id"), F.col("first.sum").alias("kept_sum"))
    found = rows.drop("text").join(kept, "tid").where(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sum") == F.col("kept_sum"))).dropDuplicates(["tid", "kept_id", "kept_sum"])
    return found.select("row.*").unionByName(rows.where("tid is null").select("row.*"))
