"""Token ids as ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, slices, written
from .subwords import encoder


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = 64 << 20) -> None:
    """Encode whole texts and write (doc_id, ids) as ORC files, ascending over files and rows.

    Rows are dealt by ranges of document ids before they are encoded, so each text is encoded once and
    only text is shuffled; ids leave the task straight into the ORC writer. A null text counts as
    empty and has the end id alone; rows with null ids come first; rows that repeat an id are kept, in an order that
    their texts decide, and may lie in several files. No rows give an empty ORC folder. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for batch in slices(batches):
            ids, n = made.encode(batch.column("text").to_pylist())
            if end_id is not None:
                at = np.cumsum(n)
                ids, n = np.insert(ids, at, end_id), n + 1
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", "text_hash", "text"]
    dealt = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(parts_for(docs), *order[:2]).sortWithinPartitions(*order)
    (
        dealt.mapInArrow(run, f"doc_id {kind}, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd").orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id and ids. Filters on doc_id skip stripes by their statistics and Bloom filters."""
    return spark.read.orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, all from the files.

    Stripes are read in parallel; each row gets its place, count and checksum there. Starts add a running sum within a
    file, in the order of its rows, to the sum of the files before it, so only a row per file meets in one place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = None, 0  # a task reads its splits of files one after the other, each in the order of its rows
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            places = []
            for own in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True):
                split, seen = own, seen + 1 if own == split else 0
                places.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(places, pa.int64()), batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["file", "block", "place", "doc_id", "n_tokens", "ids_crc32"])

    tokens = read_tokens(spark, path)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    rows = tokens.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("doc_id"), F.col("ids"))
    rows = written(rows.mapInArrow(run, f"file string, block long, place long, doc_id {kind}, n_tokens long, ids_crc32 long"), "token-digests")
    # Files hold ranges of ids in the order of their part numbers.
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("in_file")).withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("long"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file")
    return found.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
