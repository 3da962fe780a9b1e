"""Approximate nearest neighbours by inner product: a hash-prefix forest.

Every tree gives each vector a string of 64 hash bits and keeps the strings sorted. A query descends to the longest
prefix it shares in any tree, then ascends in all trees at once, one bit of prefix less at a time, which brings more
candidates. It stops at the level at which a vector as near as the last one found would have been met with the asked
probability; so clustered data need few candidates and even data many, at any size. Candidates are scored exactly.

A large index is dealt out by prefixes too: a trie over the bits of one more hash has leaves of bounded size, and each
leaf is a forest. A query first asks the leaves it lies in or next to. How near its last find is tells with which
probability a nearer vector lies in each other leaf, so it asks only as many leaves, likeliest first, as the asked
probability needs; there it looks for nothing farther than that find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import at_most, materialize

BITS = 64
#: Numbers for so many dimensions or shards are broadcast; those for more are joined.
BROADCAST_ROWS = 4_096
#: Most bits of the hash by which rows are dealt out.
ROUTE_BITS = 16


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted arrays of hash strings, one per tree, of rows of x with a norm of at most `norm`."""

    def __init__(self, x: np.ndarray, norm: float, trees: int = 64, seed: int = 1):
        self.x, self.norm, self.trees = x, norm, trees
        rng = np.random.default_rng(seed)
        self.planes = [rng.standard_normal((x.shape[1] + 1, BITS)) for _ in range(trees)]
        # one more component makes all rows equally long, so that angles order them as inner products do
        spare = np.sqrt(np.maximum(0.0, norm**2 - (x**2).sum(axis=1)))
        long = np.column_stack([x, spare])
        self.keys, self.order = [], []
        for p in self.planes:
            key = self._hash(long @ p)
            order = np.argsort(key, kind="stable")
            self.keys.append(key[order])
            self.order.append(order)

    @staticmethod
    def _hash(side: np.ndarray) -> np.ndarray:
        return np.packbits(side > 0, axis=1).view(">u8").ravel().astype(np.uint64)

    def _spans(self, keys: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last position, in every tree, of the strings that share `level` bits with each query."""
        shift = (BITS - level).astype(np.uint64)
        whole = level == 0
        mask = np.where(whole, np.uint64(0), ~np.uint64(0) << np.where(whole, np.uint64(0), shift))
        low = keys & mask
        high = low | ~mask
        a = np.stack([np.searchsorted(k, lo, "left") for k, lo in zip(self.keys, low, strict=True)])
        b = np.stack([np.searchsorted(k, hi, "right") for k, hi in zip(self.keys, high, strict=True)])
        return a, b

    def search(self, queries: np.ndarray, skip: list[np.ndarray], k: int, recall: float, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and scores of its k nearest candidates; skip: positions that are the query's own.

        floor: the score that is already reached elsewhere (minus infinity: none); nothing below it is looked for.
        """
        flat = np.column_stack([queries, np.zeros(len(queries))])
        keys = np.stack([self._hash(flat @ p) for p in self.planes])
        lengths = np.sqrt((queries**2).sum(axis=1))
        miss = 1.0 - (1.0 - recall) ** (1.0 / self.trees)

        def asked(last: np.ndarray) -> np.ndarray:
            """The level at which a vector with that score is met with the asked probability."""
            cosine = np.clip(np.where(np.isfinite(last), last, 0.0) / np.maximum(self.norm * lengths, 1e-300), -1.0, 1.0)
            agree = np.clip(1.0 - np.arccos(cosine) / np.pi, 1e-9, 1 - 1e-12)
            return np.where(np.isfinite(last), np.minimum(BITS - 1, np.floor(np.log(miss) / np.log(agree))), 0).astype(int)

        # descend: the deepest level at which the trees together hold enough strings
        low, high = np.zeros(len(queries), dtype=int), np.full(len(queries), BITS - 1)
        while (low < high).any():
            level = (low + high + 1) // 2
            a, b = self._spans(keys, level)
            enough = (b - a).sum(axis=0) >= 4 * (k + 1)
            low, high = np.where(enough, level, low), np.where(enough, high, np.maximum(level - 1, low))
        low = np.where(np.isfinite(floor), np.maximum(low, asked(floor)), low)
        found = [self._met(q, s, a, b, k) for q, s, a, b in self._each(queries, skip, keys, low)]
        # ascend: to the level at which one as near as the k-th would have been met
        last = np.maximum(floor, np.array([f[1][-1] if len(f[1]) == k else -np.inf for f in found]))
        level = np.minimum(low, asked(last))
        again = np.flatnonzero(level < low)
        for i, (q, s, a, b) in zip(again, self._each(queries[again], [skip[i] for i in again], keys[:, again], level[again]), strict=True):
            found[i] = self._met(q, s, a, b, k)
        return [(rows[score >= f], score[score >= f]) for (rows, score), f in zip(found, floor, strict=True)]

    def _each(self, queries: np.ndarray, skip: list[np.ndarray], keys: np.ndarray, level: np.ndarray) -> Iterator[tuple]:
        a, b = self._spans(keys, level)
        yield from zip(queries, skip, a.T, b.T, strict=True)

    def _met(self, query: np.ndarray, skip: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        met = np.zeros(len(self.x), dtype=bool)
        for order, lo, hi in zip(self.order, a, b, strict=True):
            met[order[lo:hi]] = True
        met[skip] = False
        rows = np.flatnonzero(met)
        score = self.x[rows] @ query
        if len(rows) > k:  # all that tie with the k-th stay until ids decide
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        order = np.lexsort((rows, -score))[:k]  # rows are in the order of vec_id
        return rows[order], score[order]


@dataclass
class Leaves:
    """The leaves of the trie of one dimension: a hash, and for each value of its bits the leaf; rows and salts of each leaf."""

    planes: np.ndarray
    norm: float
    leaf: np.ndarray
    rows: np.ndarray
    salts: np.ndarray

    @classmethod
    def of(cls, planes: np.ndarray, norm: float, counts: np.ndarray, most: int) -> Leaves:
        """The shortest prefixes that hold no more than `most` rows; where all bits are not enough, leaves are salted."""
        bits = planes.shape[1]
        level, held = np.full(len(counts), bits), counts
        for n in range(bits - 1, -1, -1):
            held = held.reshape(-1, 2).sum(axis=1)
            level = np.where(np.repeat(held <= most, 1 << (bits - n)), n, level)
        _, leaf = np.unique((level << bits) | (np.arange(len(counts)) >> (bits - level)), return_inverse=True)
        rows = np.bincount(leaf, counts).astype(np.int64)
        return cls(planes, norm, leaf, rows, np.maximum(1, -(-rows // most)))

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """The hash of rows, with the component that makes them equally long."""
        spare = np.sqrt(np.maximum(0.0, self.norm**2 - (x**2).sum(axis=1)))
        return prefixes(np.column_stack([x, spare]), self.planes)

    def likely(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The probability that a vector of that score with a query lies in each leaf."""
        length = np.maximum(np.sqrt((q**2).sum(axis=1)), 1e-300)
        margin = np.clip((q @ self.planes[:-1]) / length[:, None] / np.sqrt((self.planes**2).sum(axis=0)), -1.0, 1.0)
        cosine = np.clip(score / (self.norm * length), 0.0, 1 - 1e-12)[:, None]
        other = np.sqrt((1 - cosine**2) * (1 - margin**2) / q.shape[1]) + 1e-12
        up = 0.5 * (1.0 + _erf(margin * cosine / other / math.sqrt(2.0)))  # of the bit being set
        p = np.ones((len(q), 1))
        for k in range(self.planes.shape[1]):
            p = np.stack([p * (1 - up[:, k : k + 1]), p * up[:, k : k + 1]], axis=2).reshape(len(q), -1)
        out = np.zeros((len(q), len(self.rows)))
        for k in range(len(q)):
            out[k] = np.bincount(self.leaf, p[k], len(self.rows))
        return out


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, to 1e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    y = 1.0 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-(x**2))
    return np.sign(x) * y


def route_planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 1]).standard_normal((dim + 1, bits))


def prefixes(long: np.ndarray, planes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(long), dtype=np.int64)
    for side in (long @ planes > 0).T:
        out = (out << 1) | side
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of rows that are equal in all columns."""
    n = len(columns[0])
    if not n:
        return []
    new = np.zeros(n - 1, dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    ends = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return list(zip(ends, ends[1:]))


def _leaves(rows: DataFrame, grid: DataFrame, most: int, seed: int) -> dict[int, Leaves]:
    """The tries of the dimensions that have more than `most` rows.

    A dimension's hash has about eight values for every `most` rows, so what is collected is far below a thousandth of the rows.
    """
    large = {r["dim"]: (min(ROUTE_BITS, 3 + math.ceil(math.log2(r["n"] / most))), r["norm"]) for r in grid.where(F.col("n") > most).collect()}
    if not large:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for a, b in _runs(dims):
                bits, norm = large[int(dims[a])]
                x = _vectors(batch.column(1).slice(a, b - a), int(dims[a]))
                leaf = Leaves(route_planes(int(dims[a]), bits, seed), norm, *[np.zeros(0)] * 3)
                value, n = np.unique(leaf.prefix(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), dims[a]), pa.int32()), pa.array(value, pa.int32()), pa.array(n, pa.int64())], names=["dim", "prefix", "n"])

    counts = {d: np.zeros(1 << bits, dtype=np.int64) for d, (bits, _) in large.items()}
    found = rows.where(F.col("dim").isin([*large])).select("dim", "v").mapInArrow(run, "dim int, prefix int, n long")
    for r in found.groupBy("dim", "prefix").agg(F.sum("n").alias("n")).collect():
        counts[r["dim"]][r["prefix"]] = r["n"]
    return {d: Leaves.of(route_planes(d, bits, seed), norm, counts[d], most) for d, (bits, norm) in large.items()}


def nearest(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.92, route: float = 0.995, trees: int = 64, seed: int = 1, shard_rows: int = 16_384, query_rows: int = 262_144) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest rows with another vec_id, ties to the smaller vec_id.

    `recall` is the probability to meet a vector as near as a query's k-th within its shard; nearer ones are met more
    often. On data without any clusters, the worst case, the defaults find about 0.98 of the true neighbours. `route` is
    the probability that the leaf of such a vector is asked at all. Rows whose id is null or
    whose vector is null, empty, zero or not finite take no part; vectors meet those of their own dimension only; of
    rows that repeat id and vector, one counts. Other columns are ignored. Empty table: no rows.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    rows, asked = pick(vectors).withColumn("dim", F.size("v")), pick(queries).withColumn("dim", F.size("v"))
    norm = F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    grid = materialize(rows.groupBy("dim").agg(F.count("*").alias("n"), norm.alias("norm")), "dimensions")  # one row per dimension
    tries = spark.sparkContext.broadcast(_leaves(rows, grid, shard_rows, seed))
    few = at_most(grid, BROADCAST_ROWS)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to their leaves and salts."""
        for batch in batches:
            dims, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            leaf, salt = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims), dtype=np.int32)
            for a, b in _runs(dims):
                if (own := tries.value.get(int(dims[a]))) is not None:
                    leaf[a:b] = own.leaf[own.prefix(_vectors(batch.column(2).slice(a, b - a), int(dims[a])))]
                    salt[a:b] = ids[a:b] % own.salts[leaf[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), pa.array(salt), *(batch.column(c) for c in (1, 2))], names=["dim", "leaf", "salt", "id", "v"])

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Queries to the leaves they ask: at first those next to them, then all that may hold something nearer than `floor`."""
            for batch in batches:
                dims, ids, floors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
                out: list[tuple] = []
                for a, b in _runs(dims):
                    own = tries.value.get(int(dims[a]))
                    if own is None:
                        out += [] if first else [(int(dims[a]), 0, 0, int(i), float(f)) for i, f in zip(ids[a:b], floors[a:b], strict=True)]
                        continue
                    q = _vectors(batch.column(2).slice(a, b - a), int(dims[a]))
                    for c in range(0, b - a, 64):
                        part = slice(c, min(c + 64, b - a))
                        floor = floors[a:b][part]
                        guess = own.norm * 0.5 * np.sqrt((q[part] ** 2).sum(axis=1))
                        p = own.likely(q[part], np.where(np.isfinite(floor), floor, guess))
                        order = np.argsort(-p, axis=1, kind="stable")
                        for j, at in enumerate(order):
                            i, f = int(ids[a + c + j]), float(floor[j])
                            if first:
                                n = 1 + int(np.searchsorted(np.cumsum(own.rows[at]), 8 * (k + 1)))
                                out += [(int(dims[a]), int(x), i % int(own.salts[x]), i, f) for x in at[:n]]
                            else:
                                n = 1 + int(np.searchsorted(np.cumsum(p[j][at]), route)) if np.isfinite(f) else len(at)
                                out += [(int(dims[a]), int(x), s, i, f) for x in at[:n] if own.rows[x] for s in range(int(own.salts[x]))]
                columns = [*zip(*out, strict=True)] if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["dim", "leaf", "salt", "id", "floor"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams one shard after the other: its rows, then its queries."""
        key, held, forest, ids = None, [], None, None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in range(5)]
            floors, norms = batch.column(7).to_numpy(zero_copy_only=False), batch.column(8).to_numpy(zero_copy_only=False)
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in _runs(*columns):
                shard, x, own = tuple(int(c[a]) for c in columns[:4]), _vectors(batch.column(6).slice(a, b - a), int(columns[0][a])), batch.column(5).slice(a, b - a).to_numpy()
                if shard != key:
                    key, held, forest = shard, [], None
                if columns[4][a] == 0:
                    held.append((own, x))
                    continue
                if not held:
                    continue
                if forest is None:
                    ids = np.concatenate([h[0] for h in held])
                    forest = Forest(np.concatenate([h[1] for h in held]), float(norms[a]), trees, seed)
                for c in range(0, b - a, 256):
                    part = slice(c, min(c + 256, b - a))
                    asker = own[part]
                    skip = [np.arange(lo, hi) for lo, hi in zip(np.searchsorted(ids, asker, "left"), np.searchsorted(ids, asker, "right"), strict=True)]
                    for i, (found, score) in zip(asker, forest.search(x[part], skip, k, recall, floors[a:b][part]), strict=True):
                        got.append((np.full(len(found), i), ids[found], score))
            columns = [np.concatenate([g[c] for g in got]) if got else np.zeros(0) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t), p) for c, t, p in zip(columns, (np.int64, np.int64, np.float64), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    shard = ["dim", "leaf", "salt"]
    index = rows.select("dim", "id", "v").mapInArrow(dealt, "dim int, leaf int, salt int, id long, v array<double>")

    def searched(asks: DataFrame, first: bool) -> DataFrame:
        """asks: dim, id, v, floor."""
        went = materialize(asks.select("dim", "id", "v", "floor").mapInArrow(visits(first), "dim int, leaf int, salt int, id long, floor double"), "visits")
        blocks = at_most(materialize(went.groupBy(*shard).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks")), "blocks"), BROADCAST_ROWS)
        one = index.join(blocks, shard).select(*shard, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("part"), "id", "v", F.lit(0.0).alias("floor"))
        two = went.join(blocks, shard).select(*shard, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("part"), "id", "floor").join(asks.select("id", "dim", "v"), ["id", "dim"])
        both = one.unionByName(two.select(one.columns)).join(few.select("dim", "norm"), "dim")
        keys = [*shard, "block"]
        both = both.repartition(*keys).sortWithinPartitions(*keys, "part", "id").select(*keys, "part", "id", "v", "floor", "norm")
        return both.mapInArrow(meet, "query_id long, vec_id long, score double")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asks = asked.withColumn("floor", F.lit(float("-inf")))
    if tries.value:
        near = searched(asks, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
        # scores of two passes may differ in the last bits
        floor = near.select(F.col("query_id").alias("id"), (F.col("score") - F.abs("score") * 1e-9).alias("reached"))
        floor = materialize(floor, "floors")
        asks = asked.join(floor, "id", "left").withColumn("floor", F.coalesce("reached", F.lit(float("-inf"))))
    near = searched(asks, False)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
