"""Product codes of whole-number vectors: exact Lloyd rounds that filter codebook entries down kd-trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import fits
from .common import spread_join, written
from .vectors import whole_numbers

#: Vectors in a block, which has a tree for each of its parts and is what a task holds at a time.
BLOCK_ROWS = 4096
#: Points at which a tree ends at most.
LEAF = 16
#: Numbers in the arrays of one comparison.
AT_ONCE = 1 << 21


class KdTrees:
    """A balanced kd-tree over each part of some vectors, level by level, with the boxes, sums and counts of its nodes.

    points: vectors x parts x width. Nodes of a level follow one another, those of part 0 first; cut[l] says where each begins among the
    points in tree order; node i of level l has the children 2i and 2i + 1. order[p] is the point's part * vectors + vector.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n, self.parts, width = points.shape
        flat = np.ascontiguousarray(points.transpose(1, 0, 2)).reshape(-1, width)
        order, cut = np.arange(len(flat)), np.arange(self.parts + 1) * n
        self.cut, self.low, self.high = [cut], [], []
        while True:
            low, high = (f.reduceat(flat[order], cut[:-1], axis=0) for f in (np.minimum, np.maximum))
            self.low.append(low)
            self.high.append(high)
            size = np.diff(cut)
            if size.max() <= leaf:  # sizes of a level differ by one at most, so all can be halved before this
                break
            side = (high - low).argmax(axis=1)
            own = np.repeat(np.arange(len(size)), size)
            order = order[np.lexsort((flat[order, side[own]], own))]
            cut = np.sort(np.concatenate([cut, (cut[:-1] + cut[1:]) // 2]))
            self.cut.append(cut)
        self.n, self.order = n, order
        small = np.abs(flat).max(initial=0) < 2**31
        self.points = flat[order].astype(np.int32 if small else np.int64)

    def whole(self) -> np.ndarray:
        """Sums over the first points, so that a node's sum is a difference of two."""
        return np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0, dtype=np.int64)])


def filtered(trees: KdTrees, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, sums, counts): the nearest entry of its part's codebook for each point in tree order, ties to the lower index, and each entry's points' sum and count.

    books: parts x entries x width. A node keeps the entries that may be nearest to some point of its box: of those that are left the one nearest to the box's
    middle drops all others that are farther from every corner, and so from every point. A node with one entry left takes it for all its points, with its
    cached sum and count; what is left at the leaves is compared point by point.
    """
    parts, entries, width = books.shape
    own = np.zeros(len(trees.points), np.int64)
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    whole = trees.whole()
    exact = fits(trees.points) and fits(books.reshape(-1, width))
    if not exact:
        return _all_pairs(trees, books)
    books = books.astype(np.float64)  # exact here, and faster
    norm = (books**2).sum(axis=2)
    node, live = np.arange(parts), np.ones((parts, entries), bool)
    for level, cut in enumerate(trees.cut):
        part = node >> level
        for at in range(0, len(node), max(1, AT_ONCE // (entries * width))):
            some = slice(at, at + max(1, AT_ONCE // (entries * width)))
            low, high, book = trees.low[level][node[some]].astype(np.float64), trees.high[level][node[some]].astype(np.float64), books[part[some]]
            far = ((2 * book - (low + high)[:, None, :]) ** 2).sum(axis=2)
            best = np.where(live[some], far, np.inf).argmin(axis=1)
            row = np.arange(len(best))
            way = book - book[row, best][:, None, :]
            corner = np.where(way > 0, high[:, None, :], low[:, None, :])
            more = norm[part[some]] - norm[part[some], best][:, None] - 2 * (way * corner).sum(axis=2)
            # At the corner that favours an entry most it must still be farther, or as far with a higher index.
            gone = (more > 0) | ((more == 0) & (np.arange(entries) > best[:, None]))
            live[some] &= ~gone
        one = live.sum(axis=1) == 1
        entry = live[one].argmax(axis=1)
        start, end = cut[node[one]], cut[node[one] + 1]
        slot = part[one] * entries + entry
        np.add.at(sums, slot, whole[end] - whole[start])
        np.add.at(counts, slot, end - start)
        size = end - start
        own[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(entry, size)
        node, live = node[~one], live[~one]
        if level + 1 < len(trees.cut):
            node, live = np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(live, 2, axis=0)
    size = np.diff(trees.cut[-1])[node]
    point = np.repeat(trees.cut[-1][node], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows = live[np.repeat(np.arange(len(node)), size)]
    part = np.repeat(node >> (len(trees.cut) - 1), size)
    step = max(1, AT_ONCE // width // max(1, int(rows.sum(axis=1).max(initial=0))))
    for at in range(0, len(point), step):
        p, of = point[at : at + step], part[at : at + step]
        values = trees.points[p].astype(np.int64)
        row, entry = np.nonzero(rows[at : at + step])  # the entries that are left, by point and index
        far = ((books[of[row], entry] - values[row]) ** 2).sum(axis=1)
        cut = np.searchsorted(row, np.arange(len(p)))
        least = np.repeat(np.minimum.reduceat(far, cut), np.diff(np.concatenate([cut, [len(row)]])))
        hit = np.flatnonzero(far == least)
        own[p] = entry[hit[np.searchsorted(hit, cut)]]
        slot = of * entries + own[p]
        np.add.at(sums, slot, values)
        counts += np.bincount(slot, minlength=len(counts))
    return own, sums.reshape(books.shape), counts.reshape(parts, entries)


def _all_pairs(trees: KdTrees, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for components whose squares no double holds, with Python's integers and without bounds."""
    own = np.zeros(len(trees.points), np.int64)
    sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
    for p, point in enumerate(trees.points.tolist()):
        part = trees.order[p] // trees.n
        far = [sum((a - b) ** 2 for a, b in zip(point, entry, strict=True)) for entry in books[part].tolist()]
        own[p] = far.index(min(far))
        sums[part, own[p]] += np.array(point, object)
        counts[part, own[p]] += 1
    return own, sums, counts


def _blocks(kept: DataFrame, size: int, parts: int, rows: int) -> DataFrame:
    """(ids, labels, trees): blocks of vectors (id, v, label) with the kd-trees of their parts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            trees = KdTrees(batch.column("v").flatten().to_numpy().reshape(-1, parts, size // parts))
            ids, labels = ([batch.column(c).to_pylist()] for c in ("id", "label"))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string())), pa.array([pickle.dumps(trees)], pa.binary())], names=["ids", "labels", "trees"])

        for batch in batches:
            held.append(batch)
            while (n := sum(b.num_rows for b in held)) >= rows:
                whole = pa.concat_batches(held)
                yield made(whole.slice(0, rows))
                held = [whole.slice(rows)] if n > rows else []
        if held:
            yield made(pa.concat_batches(held))

    return kept.mapInArrow(run, "ids array<long>, labels array<string>, trees binary")


def codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(<id>, code, error, label_error, codebooks_sha256): each vector's nearest codebook entries, part by part, after so many Lloyd rounds.

    Vectors that are null or hold null or non-finite components are left out, as are those of another length than the vector with the smallest id; that
    length is a multiple of parts. Components are floor(scale * x); a part's codebook starts as that part of the vectors with the smallest ids (ties: the lesser
    vector), `entries` of them at most 256. Rows without an id get codes, but don't start a codebook; without any id there are no rows. Ties of distances go to the lower
    index; entries become the floor of the exact mean of their parts, or stay if they have none. code has two hex digits for each part; error is the sum of the
    parts' squared distances, label_error that of all rows with an equal label, nulls together. Repeated rows are rows like others. Sums beyond a long raise an error.

    Vectors are cut into blocks where they lie, without a shuffle; a block's kd-trees are built once and written. A round sends the codebooks, a fixed number of
    numbers, to the tasks and brings back a sum and a count for each entry from each task, so a vector or label that repeats weighs on no task.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    named = whole_numbers(vectors, id_col, vector_col, scale).where("id is not null")
    least = named.orderBy("id", "v").limit(1).collect()
    if not least:
        return spark.createDataFrame([], f"{id_col} long, code string, error long, label_error long, codebooks_sha256 string")
    size = len(least[0].v)
    if not size or size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    kept = whole_numbers(vectors, id_col, vector_col, scale, size, {"label": F.col(f"`{label_col}`").cast("string")})
    first = kept.where("id is not null").orderBy("id", "v").limit(entries).collect()  # `entries` rows
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy()
    blocks = written(_blocks(kept, size, parts, block_rows), "blocks")

    def summed(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for raw in batch.column("trees"):
                    _, more, n = filtered(pickle.loads(raw.as_py()), books)
                    sums += more.astype(object)
                    counts += n
            part, entry = np.nonzero(counts)
            rows = [[int(x) for x in sums[p, e]] for p, e in zip(part, entry, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(rows, pa.list_(pa.int64()))], names=["part", "entry", "n", "v"])

        return run

    for _ in range(rounds):
        found = blocks.select("trees").mapInArrow(summed(books), "part int, entry int, n long, v array<long>")
        found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(size // parts)))
        new = books.copy()
        for r in found.collect():  # parts * entries rows
            new[r["part"], r["entry"]] = [r[f"v{i}"] // r["n"] for i in range(size // parts)]
        books = new

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, raw in zip(*(batch.column(c) for c in ("ids", "labels", "trees")), strict=True):
                trees = pickle.loads(raw.as_py())
                own, _, _ = filtered(trees, books)
                part = trees.order // trees.n
                wide = np.int64 if fits(trees.points) and fits(books.reshape(-1, books.shape[2])) else object
                far = ((trees.points.astype(wide) - books[part, own].astype(wide)) ** 2).sum(axis=1)
                code, error = np.zeros((trees.parts, trees.n), np.uint8), np.zeros((trees.parts, trees.n), wide)
                code.reshape(-1)[trees.order], error.reshape(-1)[trees.order] = own, far
                total = error.sum(axis=0)
                text = [row.tobytes().hex() for row in np.ascontiguousarray(code.T)]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(text), pa.array([int(x) for x in total], pa.int64()), labels.values], names=["id", "code", "error", "label"])

    out = written(blocks.mapInArrow(final, "id long, code string, error long, label string"), "codes")
    out = out.select("id", "code", "error", F.coalesce(F.concat(F.lit("="), "label"), F.lit("~")).alias("k"))
    sums = written(out.groupBy("k").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    said = ",".join(map(str, books.reshape(-1).tolist()))
    return spread_join(out, sums, "k", "n", F.col("id")).select(F.col("id").alias(id_col), "code", "error", "label_error", F.sha2(F.lit(said), 256).alias("codebooks_sha256"))
