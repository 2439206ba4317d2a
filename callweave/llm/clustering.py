"""Exact Lloyd rounds over whole-number vectors: cover trees of vectors against a cover tree of centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import whole_numbers

#: Vectors in a block, which has a cover tree of its own and is what a task holds at a time.
BLOCK_ROWS = 1024
#: Points under which a node isn't split any more.
LEAF = 8
#: Sums of squares below this are exact in a double; larger components are taken as Python integers.
_EXACT = 2.0**53
#: Pairs of vectors whose distances are taken at once.
PAIRS = 1 << 15
#: Share by which bounds are widened against rounding.
_SLACK = 1e-9


def fits(points: np.ndarray) -> bool:
    """Whether squared distances among points with components like these are exact in doubles."""
    return 4 * float(np.abs(points).max(initial=0)) ** 2 * max(1, points.shape[1]) < _EXACT


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows: as longs where doubles would hold them, else as Python integers."""
    if fits(a) and fits(b):
        return ((a.astype(np.int64) - b) ** 2).sum(axis=1)
    return np.array([sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)], object)


class CoverTree:
    """Points in tree order; node i covers points[start[i]:end[i]], which lie within radius[i] of points[start[i]].

    The centers of a node's children lie over half its radius apart, the first is its own center. child[i] is the first child of node i, after[i]
    the one behind its last (equal: a leaf). order gives the points' numbers in tree order. Equal points make a node of radius 0, which is never split.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = len(points)
        doubles = points.astype(np.float64)
        norm = (doubles**2).sum(axis=1)
        apart = np.sqrt(np.maximum(norm[:, None] + norm[None, :] - 2 * doubles @ doubles.T, 0)) if n else np.zeros((0, 0))
        # A product's rounding, as far as a bound needs it.
        blur = np.sqrt(norm.max(initial=0) * 1e-13) if not fits(points) else 0.0
        order = np.arange(n)
        start, end, radius, child, after = [0][: n > 0], [n][: n > 0], [], [], []
        first, last = 0, len(start)
        while first < last:
            for i in range(first, last):
                own = order[start[i] : end[i]]
                far = apart[own[0], own]
                radius.append(float(far.max()) * (1 + _SLACK) + blur)
                child.append(len(start))
                if len(own) > leaf and far.max() > blur:
                    parts = self._split(own, apart, float(far.max()) / 2)
                    order[start[i] : end[i]] = np.concatenate(parts)
                    at = start[i]
                    for p in parts:
                        start.append(at)
                        at += len(p)
                        end.append(at)
                after.append(len(start))
            first, last = last, len(start)
        self.order = order
        small = np.abs(points).max(initial=0) < 2**31
        self.points = points[order].astype(np.int32 if small else np.int64)
        self.start, self.end, self.child, self.after = (np.array(x, np.int64) for x in (start, end, child, after))
        self.radius = np.array(radius)

    @staticmethod
    def _split(own: np.ndarray, apart: np.ndarray, scale: float) -> list[np.ndarray]:
        """Groups around centers that are over scale apart, each point with its nearest center."""
        centers, nearest, group = [own[0]], apart[own[0], own].copy(), np.zeros(len(own), np.int64)
        while True:
            k = int(nearest.argmax())
            if nearest[k] <= scale:
                break
            far = apart[own[k], own]
            closer = far < nearest
            group[closer] = len(centers)
            nearest[closer] = far[closer]
            centers.append(own[k])
        by = np.argsort(group, kind="stable")
        parts = np.split(own[by], np.cumsum(np.bincount(group, minlength=len(centers)))[:-1])
        # Each group begins with its center.
        return [np.concatenate([[c], p[p != c]]) for c, p in zip(centers, parts, strict=True)]


def assigned(tree: CoverTree, centroids: CoverTree) -> np.ndarray:
    """The number of the nearest centroid of each point of tree, in its order; ties go to the smaller number.

    Both trees are descended at once, level by level. A pair of nodes is dropped where the nearest that the centroids' node can come
    to any point is farther than the farthest that another one must stay; a node left with one centroid takes it for all its points. What
    is left at the leaves is compared exactly.
    """
    out = np.full(len(tree.points), -1, np.int64)
    if not len(tree.points):
        return out
    at = tree.points[tree.start].astype(np.float64)
    to = centroids.points[centroids.start].astype(np.float64)
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(node):
        far = np.concatenate([np.sqrt(((at[node[i : i + PAIRS]] - to[other[i : i + PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(node), PAIRS)])
        reach = tree.radius[node] + centroids.radius[other]
        slack = _SLACK * (far + reach + 1)
        live = far - reach - slack <= _each(np.minimum, far + reach + slack, node)
        node, other = node[live], other[live]
        alone = (_each(np.add, np.ones(len(node), np.int64), node) == 1) & (centroids.end[other] - centroids.start[other] == 1)
        for n, c in zip(node[alone], other[alone], strict=True):
            out[tree.start[n] : tree.end[n]] = centroids.order[centroids.start[c]]
        node, other = node[~alone], other[~alone]
        # A node's pairs are compared together, once none of them can be split.
        ended = _each(np.logical_and, (tree.child[node] == tree.after[node]) & (centroids.child[other] == centroids.after[other]), node)
        _compare(tree, centroids, node[ended], other[ended], out)
        node, other = _deeper(*_deeper(node[~ended], other[~ended], centroids, 1), tree, 0)
    return out


def _each(fold: np.ufunc, values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """values folded over each run of equal keys, for every row of the run."""
    cut = _cuts(key)
    return np.repeat(fold.reduceat(values, cut), np.diff(np.concatenate([cut, [len(key)]]))) if len(key) else values


def _deeper(node: np.ndarray, other: np.ndarray, tree: CoverTree, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the nodes of one side replaced by their children, leaves by themselves; sorted by the vectors' node."""
    own = other if side else node
    n = tree.after[own] - tree.child[own]
    leaf = n == 0
    n = np.where(leaf, 1, n)
    first = np.where(leaf, own, tree.child[own])
    made = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair = (np.repeat(node, n), made) if side else (made, np.repeat(other, n))
    by = np.argsort(pair[0], kind="stable")
    return pair[0][by], pair[1][by]


def _compare(tree: CoverTree, centroids: CoverTree, node: np.ndarray, other: np.ndarray, out: np.ndarray) -> None:
    """Fill in the nearest centroid for the points of leaves, among the centroids of the leaves that they are paired with."""
    if not len(node):
        return
    rows, cols = tree.end[node] - tree.start[node], centroids.end[other] - centroids.start[other]
    n = rows * cols
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(cols, n)
    point, c = np.repeat(tree.start[node], n) + k // wide, np.repeat(centroids.start[other], n) + k % wide
    number = centroids.order[c]
    by = np.lexsort((number, point))
    point, c, number = point[by], c[by], number[by]
    for at in _pieces(point, PAIRS):
        p, own = point[at], number[at]
        far = squared(tree.points[p], centroids.points[c[at]])
        cut = _cuts(p)
        least = np.repeat(np.minimum.reduceat(far, cut), np.diff(np.concatenate([cut, [len(p)]])))
        hit = np.flatnonzero(far == least)
        out[p[cut]] = own[hit[np.searchsorted(hit, cut)]]


def _cuts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _pieces(key: np.ndarray, size: int) -> Iterator[slice]:
    """Slices of about size rows that keep equal keys, which are sorted, together."""
    at = 0
    while at < len(key):
        to = len(key) if at + size >= len(key) else max(int(np.searchsorted(key, key[at + size])), int(np.searchsorted(key, key[at], side="right")))
        yield slice(at, to)
        at = to


def _blocks(kept: DataFrame, size: int, rows: int) -> DataFrame:
    """(ids, tree): blocks of vectors (id, v) with their cover trees, as bytes."""
    import pickle

    def made(ids: list, vectors: np.ndarray) -> pa.RecordBatch:
        tree = CoverTree(vectors)
        return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in tree.order]], pa.list_(pa.int64())), pa.array([pickle.dumps(tree)], pa.binary())], names=["ids", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            held.append(batch.column("v").flatten().to_numpy().reshape(-1, size))
            while len(ids) >= rows:
                whole = np.concatenate(held)
                yield made(ids[:rows], whole[:rows])
                ids, held = ids[rows:], [whole[rows:]]
        if ids:
            yield made(ids, np.concatenate(held))

    return kept.mapInArrow(run, "ids array<long>, tree binary")


def lloyd(vectors: DataFrame, k: int, rounds: int, seed: int, size: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(<id>, cluster, distance, cluster_inertia, inertia, centroid_sha256): the nearest of k centroids of every vector after so many Lloyd rounds.

    Vectors of exactly `size` components, none of them null or non-finite, take part, with floor(scale * x) for a component; all others are left
    out. The first centroids are the k vectors with the least SHA-256 of "<seed>:<id>", in that order (ties: the lesser vector); rows without
    an id are clustered, but never chosen. Ties of distances go to the smaller number; a round's centroid is the floor of
    the exact mean of its vectors, or stays if it has none. Fewer vectors with an id give fewer centroids, and none at all no rows. Repeated rows are rows like others. A
    distance or sum beyond a long raises an error.

    Vectors are cut into blocks where they lie, without a shuffle; a block's cover tree is built once and written. A round sends the centroids,
    k rows of a fixed size, to the tasks, which build the centroids' tree and descend both; each task hands on one sum and count for each cluster, so
    neither a large cluster nor a vector that repeats weighs on one task, and k rows come back to the driver.
    """
    spark = vectors.sparkSession
    kept = whole_numbers(vectors, id_col, vector_col, scale, size)
    named = kept.where("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
    first = named.orderBy("h", "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.v for r in first], np.int64)
    blocks = written(_blocks(kept, size, block_rows), "blocks")

    def nearest(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
        import pickle

        tree = CoverTree(centroids, leaf=1)
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("tree"), strict=True):
                block = pickle.loads(raw.as_py())
                yield ids.values, block.points, assigned(block, tree)

    def summed(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
            for _, points, own in nearest(batches, centroids):
                by = np.argsort(own, kind="stable")
                found, at = np.unique(own[by], return_index=True)
                wide = points.astype(np.int64 if np.abs(points).max(initial=0) < 2**40 else object)
                total[found] += np.add.reduceat(wide[by], at, axis=0).astype(object)
                n += np.bincount(own, minlength=len(n))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array([[int(x) for x in total[c]] for c in used], pa.list_(pa.int64()))], names=["cluster", "n", "v"])

        return run

    for _ in range(rounds):
        parts = blocks.select("ids", "tree").mapInArrow(summed(centroids), "cluster int, n long, v array<long>")
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(size)))
        new = centroids.copy()
        for row in found.collect():  # k rows
            new[row["cluster"]] = [row[f"v{i}"] // row["n"] for i in range(size)]
        centroids = new

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, own in nearest(batches, centroids):
            far = squared(points, centroids[own])
            yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.int32()), pa.array([int(x) for x in far], pa.int64())], names=[id_col, "cluster", "distance"])

    out = written(blocks.mapInArrow(final, f"{id_col} long, cluster int, distance long"), "clusters")
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()  # k rows
    by_cluster = {r["cluster"]: r["own"] for r in inertia}
    named = [(c, by_cluster.get(c), ",".join(map(str, centroids[c].tolist()))) for c in range(len(centroids))]
    known = spark.createDataFrame(named, "cluster int, cluster_inertia long, components string")
    known = known.select("cluster", "cluster_inertia", F.lit(sum(by_cluster.values())).cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256"))
    return out.join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
