"""Exact dedup: groups by a 128-bit content hash, with the bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, row_key, spread_join, without, written

#: Bits of the hash that decide which texts are compared; bounds what is broadcast (2^18 numbers).
BUCKET_BITS = 18


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are. Of equal texts the row with the smallest (or largest) id
    stays. A null text counts as empty; empty texts are equal to each other. Rows whose id is null
    never stay beside rows with an id; if no row of a group has one, all stay and keep_id is null.
    Rows that repeat the id that stays are all marked kept. No rows give no rows; other columns are
    dropped.

    Only hashes are grouped and joined. Texts move once, for the byte comparison, and only those that
    share their hash's first bits with some repeated hash; copies are merged before that shuffle. Rows
    whose hash stands for several texts are grouped by the text itself. Keys that hold many rows are
    broadcast (but for whole texts of colliding hashes, which are too long), so no task gets all rows of a group.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", hash_of(F.col("text")).cast("string"))
    base = written(texts.select("id", "hash", F.sha2("text", 256).alias("text_sha256")), "hashes")
    dups = written(base.groupBy("hash").agg(F.count("*").alias("group_size"), best("id").alias("keep_id")).where("group_size > 1"), "repeated")

    bucket = F.pmod(F.xxhash64("hash"), F.lit(1 << BUCKET_BITS))
    maybe = texts.withColumn("bucket", bucket).join(F.broadcast(dups.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
    classes = maybe.groupBy("hash", "text").agg(F.count("*").alias("group_size"), best("id").alias("keep_id"))
    clash = written(classes.groupBy("hash").count().where("count > 1").select("hash"), "clashes")

    if clash.isEmpty():
        found = spread_join(base, dups, "hash", "group_size", F.col("id"))
    else:
        plain = spread_join(base.join(clash, "hash", "left_anti"), dups, "hash", "group_size", F.col("id"))
        apart = texts.join(clash, "hash", "left_semi").withColumn("text_sha256", F.sha2("text", 256))
        by_text = classes.join(clash, "hash", "left_semi").select("text", "group_size", "keep_id")
        found = plain.unionByName(spread_join(apart, by_text, "text", "group_size", F.col("id")).drop("text"))
    size = F.coalesce("group_size", F.lit(1))
    found = found.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")))
    return found.select(F.col("id").alias(id_col), "keep_id", size.cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text: the one with the smallest id, of rows that repeat it too the least as JSON.

    A null text counts as empty, a null id comes after all others. No rows give no rows; all columns are kept. Texts stay
    where they are but for those of rows that repeat id and text; of these each task first keeps one of a kind.
    """
    groups = exact_groups(docs, "smallest", id_col, text_col)
    same = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("~")), "text_sha256").alias("key")
    groups = written(groups.where("group_size > 1").select(same, "kept"), "grouped")
    kept = without(docs, groups.where("not kept").select("key"), row_key(id_col, text_col))
    twice = written(groups.where("kept").groupBy("key").count().where("count > 1").select("key"), "repeated-rows")
    if twice.isEmpty():
        return kept
    key, other = free_name(docs, "key"), free_name(docs, "other")
    marked = kept.withColumn(key, row_key(id_col, text_col)).join(twice.withColumnRenamed("key", other), F.col(key) == F.col(other), "left")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = marked.where(F.col(other).isNotNull()).groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return marked.where(F.col(other).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(first)
