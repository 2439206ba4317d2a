"""Packing token ids into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .subwords import TABLE_BYTES, encoder

#: Ids held by a task before what it has is packed; bounds a task's memory.
WINDOW_IDS = 2 << 20


def fill(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths whose sum comes closest to capacity without passing it.

    counts[n]: pieces of length n. Bit s of reach is set if some multiset sums to s; each length is
    added by binary splitting of its count (1, 2, 4, ... copies at once). One state of reach is kept
    for each step, and walking them backwards gives how often each length is used.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for n in np.flatnonzero(counts)[::-1].tolist():
        left, k = min(int(counts[n]), capacity // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & full
            left -= k
            k *= 2
        if reach >> capacity & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + k
            at -= n * k
    return sorted(used.items(), reverse=True)


def bins(lengths: np.ndarray, capacity: int) -> tuple[list[list[int]], list[int]]:
    """Exactly full bins of positions in lengths, and the positions left once no multiset fills a bin.

    A multiset found once is taken as often as the counts allow before the next search.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    held: dict[int, list[int]] = {}
    for i in np.argsort(-np.arange(len(lengths))).tolist():
        held.setdefault(int(lengths[i]), []).append(i)
    full = []
    while True:
        best = fill(counts, capacity)
        if not best or sum(n * k for n, k in best) < capacity:
            return full, sorted(i for own in held.values() for i in own)
        for _ in range(min(int(counts[n]) // k for n, k in best)):
            full.append([held[n].pop() for n, k in best for _ in range(k)])
        for n, k in best:
            counts[n] = len(held[n])


def layout(lengths: np.ndarray, capacity: int, final: bool, most_left: int = WINDOW_IDS // 4) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]], int]:
    """Pieces (item, start, length, sequence, offset), what is left over as (item, start), and the sequences made.

    Whole windows are cut from the front of long items; the remainders go into exactly full bins.
    What no multiset fills waits for more items, unless it is over most_left ids; then it is laid end to end and cut at the capacity,
    and less than one window waits. At the end (final) the last of it becomes sequences of lengths that are powers of
    two, which need no padding.
    """
    pieces, seq = [], 0
    for i in np.flatnonzero(lengths >= capacity).tolist():
        for k in range(int(lengths[i]) // capacity):
            pieces.append((i, k * capacity, capacity, seq, 0))
            seq += 1
    rest = lengths % capacity
    item = np.flatnonzero(rest)
    full, left = bins(rest[item], capacity)
    for own in full:
        at = 0
        for j in own:
            i = int(item[j])
            pieces.append((i, int(lengths[i] - rest[i]), int(rest[i]), seq, at))
            at += int(rest[i])
        seq += 1
    loose = [(int(item[j]), int(lengths[item[j]] - rest[item[j]])) for j in left]
    total = sum(int(lengths[i]) - s for i, s in loose)
    if not final and total <= most_left:
        return pieces, loose, seq
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if final and (total % capacity) >> b & 1]
    sizes.reverse()
    at, room, waiting = 0, sizes.pop() if sizes else 0, []
    for i, s in loose:
        while room and s < lengths[i]:
            take = min(room, int(lengths[i]) - s)
            pieces.append((i, s, take, seq, at))
            s, at, room = s + take, at + take, room - take
            if not room:
                seq, at, room = seq + 1, 0, sizes.pop() if sizes else 0
        if s < lengths[i]:
            waiting.append((i, s))
    return pieces, waiting, seq


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int | None = 1, mark: str = " \x01 ", id_col: str = "doc_id", text_col: str = "text", window_ids: int = WINDOW_IDS, with_ids: bool = False, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Encode whole texts, append end_id and pack the ids into sequences of at most capacity ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the
    ids themselves as token_ids, if asked for). A null text counts as empty: it has the end id alone;
    without an end id it has no piece. Null and repeated ids are rows like others, no rows give no
    pieces, other columns are dropped.

    table_bytes bounds what a worker remembers of words. Each partition packs what it holds, window by window, without a shuffle; unfilled remainders, a quarter of a window
    at most, move on to the partition's next window. Sequences are numbered by partition, so a task that runs again
    makes the same rows.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        made = encoder(vocabulary, mark=mark, most=table_bytes)
        names: list = []  # of the items in the window, with their ids, what is done of them, and length
        ids: list[np.ndarray] = []
        done: list[int] = []
        whole: list[int] = []
        held, seq = 0, 0

        def flush(final: bool) -> pa.RecordBatch:
            nonlocal names, ids, done, whole, held, seq
            pieces, loose, used = layout(np.array([len(x) for x in ids], np.int64), capacity, final, window_ids // 4)
            cols: list[list] = [[] for _ in range(8)]
            for i, s, n, q, at in pieces:
                own = ids[i][s : s + n]
                for col, value in zip(cols, (names[i], done[i] + s, n, zlib.crc32(own.tobytes()), whole[i], first + seq + q, at, own), strict=True):
                    col.append(value)
            seq += used
            names, ids, done, whole = [names[i] for i, _ in loose], [ids[i][s:] for i, s in loose], [done[i] + s for i, s in loose], [whole[i] for i, _ in loose]
            held = sum(map(len, ids))
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(cols[2])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*cols[7], np.zeros(0, "<u4")]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names=out_names)

        id_type = pa.int64()
        for batch in slices(batches):
            id_type = batch.column("id").type
            found, n = made.encode(batch.column("text").to_pylist())
            if end_id is not None:
                found, n = np.insert(found, np.cumsum(n), end_id), n + 1
            for name, own in zip(batch.column("id").to_pylist(), np.split(found.astype("<u4"), np.cumsum(n)[:-1]), strict=True):
                if len(own):
                    names.append(name), ids.append(own), done.append(0), whole.append(len(own))
                    held += len(own)
            if held >= window_ids:
                yield flush(False)
        if names:
            yield flush(True)

    columns = {"id": kind, "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long"} | ({"token_ids": "array<int>"} if with_ids else {})
    out_names = list(columns)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in columns.items())).withColumnRenamed("id", id_col)


def padding(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, tokens and padding of packed pieces (none for lengths that are powers of two)."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("size"))
    bare = F.expr("size & (size - 1)") == 0
    return sizes.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(bare, 0).otherwise(F.lit(capacity) - F.col("size"))), F.lit(0)).alias("padding"))
