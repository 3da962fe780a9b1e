"""Exact integer k-means by filtering: kd-trees over parts of the vectors, whole nodes assigned where one centroid is left.

Vectors become integers once and are cut, as they stream by, into trees of bounded size, one row each of a written
table. A node holds its vectors' count, integer sums and bounding box. In a round every tree is descended with the
current centroids: a centroid that is strictly farther than another from every point of a node's box is pruned; a node
with one centroid left is assigned as a whole through its sums; leaves compare each vector with what is left. Only sums
by centroid leave a task. Pruning is strict, so ties reach the leaves, where the smaller number wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import drop_written, materialize, small_batches

#: Scaled components stay below this, so that no distance or product here passes a long.
LIMIT = 1 << 26
_TREES = "tree long, ids array<long>, vectors binary, bounds binary, children binary, low binary, high binary, sums binary"


def integers(vectors: DataFrame, *, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id, x: floor(scale * component) of the vectors with `dims` components that are all finite and fit."""
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = (F.size(vector) == dims) & F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(F.lit(float(scale)) * c.cast("double")) < float(LIMIT)))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))


def grow(x: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A kd-tree over the rows of x: their order, and per node (parents first) bounds, children (-1: leaf), low, high, sums."""
    order = np.arange(len(x))
    bounds, children, low, high, sums = [(0, len(x))], [], [], [], []
    for a, b in bounds:  # grows meanwhile
        own = x[order[a:b]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        sums.append(own.sum(axis=0))
        extent = high[-1] - low[-1]
        axis = int(extent.argmax())
        if b - a <= leaf or not extent[axis]:
            children.append((-1, -1))
            continue
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
        children.append((len(bounds), len(bounds) + 1))
        bounds += [(a, a + middle), (a + middle, b)]
    return order, {"bounds": np.array(bounds), "children": np.array(children), "low": np.array(low), "high": np.array(high), "sums": np.array(sums)}


def descend(x: np.ndarray, tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of every row of x (in tree order), and count and sums by centroid, by filtering the tree."""
    k = len(centroids)
    label, count, sums = np.zeros(len(x), dtype=np.int32), np.zeros(k, dtype=np.int64), np.zeros_like(centroids)
    nodes, alive = np.array([0]), np.ones((1, k), dtype=bool)
    while len(nodes):
        low, high = tree["low"][nodes], tree["high"][nodes]
        middle = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(axis=2)
        best = np.where(alive, middle, np.iinfo(np.int64).max).argmin(axis=1)
        toward = centroids[None] - centroids[best][:, None]
        corner = np.where(toward > 0, high[:, None], low[:, None])  # where a centroid is best off against the best one
        alive &= (toward * (centroids[None] + centroids[best][:, None] - 2 * corner)).sum(axis=2) <= 0
        whole = alive.sum(axis=1) == 1
        for n, z in zip(nodes[whole], best[whole], strict=True):
            a, b = tree["bounds"][n]
            label[a:b] = z
            count[z] += b - a
            sums[z] += tree["sums"][n]
        leaf = ~whole & (tree["children"][nodes, 0] < 0)
        if leaf.any():
            spans = tree["bounds"][nodes[leaf]]
            lengths = spans[:, 1] - spans[:, 0]
            rows = np.repeat(spans[:, 0] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            left = np.repeat(alive[leaf], lengths, axis=0)
            found = np.zeros(len(rows), dtype=np.int32)
            for a in range(0, len(rows), 4096):
                far = ((x[rows[a : a + 4096], None] - centroids[None]) ** 2).sum(axis=2)
                found[a : a + 4096] = np.where(left[a : a + 4096], far, np.iinfo(np.int64).max).argmin(axis=1)
            label[rows] = found
            count += np.bincount(found, minlength=k)
            np.add.at(sums, found, x[rows])
        down = ~whole & ~leaf
        nodes, alive = tree["children"][nodes[down]].ravel(), np.repeat(alive[down], 2, axis=0)
    return label, count, sums


def plant(rows: DataFrame, dims: int, *, leaf: int = 16, tree: int = 8192) -> DataFrame:
    """The written trees over all rows (vec_id, x): each task cuts its stream into trees of at most so many vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held = TaskContext.get().partitionId() << 32, [], np.zeros((0, dims), dtype=np.int64)

        def out(n: int) -> pa.RecordBatch:
            nonlocal number, ids, held
            order, nodes = grow(held[:n], leaf)
            row = {"tree": number, "ids": [ids[k] for k in order], "vectors": held[order].astype("<i4").tobytes()}
            row |= {c: nodes[c].astype(kind).tobytes() for c, kind in (("bounds", "<i4"), ("children", "<i4"), ("low", "<i4"), ("high", "<i4"), ("sums", "<i8"))}
            number, ids, held = number + 1, ids[n:], held[n:]
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("tree", pa.int64()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("vectors", "bounds", "children", "low", "high", "sums"))]))

        for batch in batches:
            ids = ids + batch.column(0).to_pylist()
            held = np.concatenate([held, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)])
            while len(ids) >= tree:
                yield out(tree)
        if ids:
            yield out(len(ids))

    with small_batches(rows.sparkSession, 4096):
        return materialize(rows.mapInArrow(run, _TREES), "kd-trees")


def _trees(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray, dict[str, np.ndarray]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            read = lambda c, kind, width: np.frombuffer(row[c], dtype=kind).astype(np.int64).reshape(-1, width)  # noqa: B023, E731
            yield row["ids"], read("vectors", "<i4", dims), {"bounds": read("bounds", "<i4", 2), "children": read("children", "<i4", 2), "low": read("low", "<i4", dims), "high": read("high", "<i4", dims), "sums": read("sums", "<i8", dims)}


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By centroid: how many vectors it has, and their sums. One row for each centroid and task leaves the tasks."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for _, x, tree in _trees(batches, dims):
            _, n, s = descend(x, tree, centroids)
            count, sums = count + n, sums + s
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(count)), pa.int32()), "n": pa.array(count, pa.int64()), "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    rows = trees.mapInArrow(run, "cluster int, n long, sums array<long>").where("n > 0")
    total = rows.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dims)])
    return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in total.collect()}


def _labels(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, tree in _trees(batches, dims):
            label, _, _ = descend(x, tree, centroids)
            far = ((x - centroids[label]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(label, pa.int32()), "distance": pa.array(far, pa.int64())})

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", leaf: int = 16, tree: int = 8192) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors with exactly `dims` components, none null, NaN, infinite or of LIMIT / scale and more in size;
    each component becomes floor(scale * component). Centroids start as the k kept vectors with the smallest SHA-256
    of `<seed>:<vec_id>`; a null vec_id comes last, equal ones are ordered by their components, and repeated rows can
    be several centroids (the later ones stay empty, since ties go to the smaller number). Fewer than k vectors: as
    many centroids. No vector: no rows. A round replaces a centroid by the floor of its vectors' mean, an empty one
    stays; a round that changes nothing ends the rounds, as all later ones would be alike. Other columns are ignored.
    Inertias that pass a long are null.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, vec_id=vec_id, vector=vector, dims=dims, scale=scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], dtype=np.int64)
    trees = plant(rows, dims, leaf=leaf, tree=tree)
    with small_batches(spark, 16):
        for _ in range(rounds):
            found = _sums(trees, centroids)
            moved = np.array([[s // found[c][0] for s in found[c][1]] if c in found else list(map(int, old)) for c, old in enumerate(centroids)], dtype=np.int64)
            if (moved == centroids).all():
                break
            centroids = moved
        labels = materialize(_labels(trees, centroids), "kd-labels")
    drop_written(trees)
    own = {r[0]: int(r[1]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    final = [(c, fits(n), fits(sum(own.values())), said[c]) for c, n in sorted(own.items())]
    return labels.join(F.broadcast(spark.createDataFrame(final, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
