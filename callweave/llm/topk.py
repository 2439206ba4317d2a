"""Exact top-k inner products: long vectors first, pruned by partial sums and residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, storage, written

#: Rows in the head that gives the rotation and the first thresholds; bounds what the driver holds and sends.
HEAD_ROWS = 2048
#: Components of vectors in a block, which a task holds, and queries that a task meets with its block at most.
BLOCK_VALUES = 1 << 22
QUERY_SLICE = 1 << 19
#: Queries held against a block at once.
AT_ONCE = 2048
_LIMIT = (1 << 63) - 1
_ROUNDING = 1e-9


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float | None) -> DataFrame:
    """(id, v): components as double, floor(scale * x) if a scale is given; vectors null or with null or non-finite components and rows without an id are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where("id is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return rows if scale is None else rows.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows of equal length; short vectors end in zeros."""
    n = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (n == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(n), size))
    out[np.arange(size) < n[:, None]] = values
    return out


def _products(queries: np.ndarray, rows: np.ndarray, safe: bool) -> np.ndarray:
    """Whole-number inner products of paired rows; safe: doubles hold them exactly."""
    if safe:
        return np.einsum("ij,ij->i", queries, rows).astype(np.int64)
    return np.array([max(-_LIMIT, min(_LIMIT, sum(int(a) * int(b) for a, b in zip(q, r, strict=True)))) for q, r in zip(queries, rows, strict=True)], np.int64)


def rows_of(path: str, columns: list[str], reached: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a written folder, AT_ONCE at a time; reached: of queries, those that can reach beyond that block."""
    import pyarrow.dataset as ds

    fs, at = storage(path)
    yield from ds.dataset(at, filesystem=fs, format="parquet").to_batches(columns=columns, batch_size=AT_ONCE, filter=None if reached is None else ds.field("reached") > reached, batch_readahead=0, fragment_readahead=0, use_threads=False)


class Block:
    """Vectors, longest first, with their rotated coordinates, their norms and the norms of what follows the first coordinates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, rotation: np.ndarray, first: int):
        turned = rows @ rotation
        norm = np.sqrt((turned**2).sum(1))
        order = np.argsort(-norm, kind="stable")
        self.ids, self.rows, self.norm = ids[order], rows[order], norm[order]
        self.front = np.ascontiguousarray(turned[order, :first])
        self.rest = np.sqrt((turned[order, first:] ** 2).sum(1))
        self.top = np.abs(rows).max(initial=0)


class Search:
    """Some queries, with a threshold each, that look for their k best in a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, rotation: np.ndarray, first: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        turned = queries @ rotation
        self.front, self.norm = turned[:, :first], np.sqrt((turned**2).sum(1))
        self.rest = np.sqrt((turned[:, first:] ** 2).sum(1))
        self.top = np.abs(queries).max(initial=0)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def least_norm(self) -> np.ndarray:
        """Vectors shorter than this can't reach a query's threshold."""
        own = _ROUNDING * (self.norm + 1)
        return (self.floor - 1 - own) / np.maximum(self.norm + own, _ROUNDING) - _ROUNDING

    def take(self, block: Block, at_most: int = 1 << 21) -> None:
        if not len(block.ids) or not len(self.ids):
            return
        # Rounding of the products stays far below this share of the norms' product.
        slack = 1 + _ROUNDING * (self.norm + 1) * (block.norm[0] + 1)
        step = max(16, min(1024, at_most // len(self.ids)))
        for a in range(0, len(block.ids), step):
            part = slice(a, a + step)
            live = np.flatnonzero(self.norm * block.norm[a] + slack >= self.floor)
            if not len(live):
                return
            bound = self.front[live] @ block.front[part].T
            bound += np.outer(self.rest[live], block.rest[part])
            q, r = np.nonzero(bound + slack[live, None] >= self.floor[live, None])
            q, r = live[q], r + a
            apart = self.ids[q] != block.ids[r]
            self._add(q[apart], r[apart], block)

    def _add(self, q: np.ndarray, r: np.ndarray, block: Block) -> None:
        safe = self.top * block.top * max(1, block.rows.shape[1]) < 2**53
        score = np.concatenate([_products(self.queries[q[a : a + 65536]], block.rows[r[a : a + 65536]], safe) for a in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
        keep = score >= self.floor[q]
        if not keep.any():
            return
        q, ids, score = (np.concatenate([old, new[keep]]) for old, new in zip(self.found, (q, block.ids[r], score), strict=True))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
        q, ids, score, place = (x[place < self.k] for x in (q, ids, score, place))
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.found = q, ids, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", head_rows: int = HEAD_ROWS, block_values: int = BLOCK_VALUES, query_slice: int = QUERY_SLICE, first: int | None = None) -> DataFrame:
    """(query_id, rank, <id>, score): each query's k largest whole-number inner products with rows of other ids.

    Ties go to the smaller id; fewer candidates give fewer rows. Components are whole numbers after
    floor(scale * x). Vectors that are null or hold null or non-finite components take no part; nor do rows
    without an id. A shorter vector counts as ending in zeros. Rows that repeat an id are candidates of their own; a query id that
    repeats is asked once, with its smallest vector. Scores beyond 64 bits stay at the limit.

    The vectors are sorted by length and cut into blocks that a task can hold. The head, a bounded number of the longest
    ones, gives the rotation (its right singular vectors) and, in tasks, each query's first threshold. A query then goes
    only to the blocks, the first ones in that order, whose longest vector could reach its threshold; every pair of a block and a slice of the queries
    is one task's, which reads both from the shared folder, the queries some at a time, so that what is shuffled are the pairs' numbers and never vectors. There vectors are taken longest first, queries whose norms can't reach their thresholds any more are
    left out, the bound of the remaining coordinates (Cauchy-Schwarz) is added to the partial sum of the first ones, and only
    what that leaves is multiplied out. A block hands on k rows for a query at most. The driver holds the head and one norm for each block.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(scaled(vectors, id_col, vector_col, scale).select("id", "v", norm.alias("norm"), F.monotonically_increasing_id().alias("n")), "vectors")
    asked = written(scaled(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v")), "queries")
    total, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    n_asked, longest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    size = max(size or 0, longest or 0, 1)
    head = rows.orderBy(F.desc("norm"), "id", "v").limit(head_rows).select("id", "v").toArrow()
    head_ids, head_vectors = head.column("id").to_numpy(), _matrix(head.column("v").combine_chunks(), size)
    rotation = np.linalg.svd(head_vectors / max(1.0, np.abs(head_vectors).max(initial=0)), full_matrices=True)[2].T if len(head_ids) else np.eye(size)
    first = first or max(1, size // 4)

    # The place n parts vectors of one length, also where rows repeat.
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * size // block_values))
    dealt = rows.repartitionByRange(count, F.desc("norm"), "n").select(F.spark_partition_id().alias("block"), "id", "v", "norm")
    block_path = scratch(spark, "blocks")
    dealt.write.partitionBy("block").parquet(block_path)
    blocks = spark.read.schema("id long, v array<double>, norm double, block int").parquet(block_path)
    tops = np.full(count, -1.0)
    for block, top in blocks.groupBy("block").agg(F.max("norm")).collect():  # one row a block
        tops[block] = top
    tops = np.maximum.accumulate(tops[::-1])  # ascending, from the last block to the first

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = Block(head_ids, head_vectors, rotation, first)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                own = batch.slice(at, AT_ONCE)
                search = Search(own.column("id").to_numpy(), _matrix(own.column("v"), size), k, rotation, first)
                search.take(longest)
                reached = count - np.searchsorted(tops, search.least_norm())
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("v"), pa.array(search.floor), pa.array(reached.astype(np.int32))], names=["id", "v", "floor", "reached"])

    def block_of(number: int) -> Block | None:
        held = [(b.column("id").to_numpy(), _matrix(b.column("v"), size)) for b in rows_of(f"{block_path}/block={number}", ["id", "v"]) if b.num_rows]
        return Block(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), rotation, first) if held else None

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            for place, part in zip(*(batch.column(c).to_pylist() for c in ("block", "slice")), strict=True):
                if place != number:
                    number, block = place, None
                    block = block_of(place)
                for some in rows_of(f"{query_path}/slice={part}", ["id", "v", "floor"], reached=place) if block else ():
                    if not some.num_rows:
                        continue
                    ids = some.column("id").to_numpy()
                    search = Search(ids, _matrix(some.column("v"), size), k, rotation, first, some.column("floor").to_numpy())
                    search.take(block)
                    q, other, score = search.found
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(other), pa.array(score)], names=["query_id", "other", "score"])

    slices = max(1, -(-n_asked // query_slice))
    query_path = scratch(spark, "aimed")
    aim = asked.mapInArrow(aimed, "id long, v array<double>, floor double, reached int").where("reached > 0").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    aim.repartition("slice").sortWithinPartitions("slice", F.desc("reached")).write.partitionBy("slice").parquet(query_path)
    # Only numbers are dealt out: what a slice's farthest query can reach, block by block.
    aimed_rows = spark.read.schema("id long, v array<double>, floor double, reached int, slice int").parquet(query_path)
    pairs = aimed_rows.groupBy("slice").agg(F.max("reached").alias("reached")).select(F.explode(F.sequence(F.lit(0), F.col("reached") - 1)).alias("block"), "slice")
    pairs = pairs.repartition(min(count * slices, 1 << 20), "block", "slice").sortWithinPartitions("block", "slice")
    found = pairs.mapInArrow(met, "query_id long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("other").alias(id_col), "score")
