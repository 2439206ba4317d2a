"""Helpers shared by the corpus operators: scratch tables and Arrow batch slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time inside a Python task; bounds a task's memory.
BATCH_BYTES = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the session's Python workers, once, unless PYTHONPATH names its folder anyway."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    app = spark.sparkContext.applicationId
    if app in _shipped or top in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = os.path.join(tempfile.mkdtemp(prefix="spark-"), "callweave.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "callweave")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    spark.sparkContext.addPyFile(made)
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and Spark runs on one machine (tests) a temporary folder is set as the checkpoint folder;
    on a cluster that is an error, as its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get()
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}/{name}"


def storage(uri: str):
    """The filesystem of a shared folder, and the path in it."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_passing: list[list[str]] = []


class passing:
    """Tables that `written` makes inside are deleted at the end, but for those it is told to keep; those go with what is around, if anything."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        _passing.append([])

    def __exit__(self, *error) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in _passing.pop():
            folder = jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
            folder.getFileSystem(conf).delete(folder, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors. keep: see `passing`."""
    path = scratch(df.sparkSession, name)
    if len(_passing) > keep:
        _passing[-1 - keep].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(docs: DataFrame, each: int = 128 << 20) -> int:
    """Partitions for a shuffle of all of docs: of `each` bytes by Spark's own estimate of its size, and as many as the session asks for at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 1 << 20))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold at most about `most` bytes of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


#: Bytes of rows, as JSON, that spread_join broadcasts at most, and the parts that it cuts a hot key's rows into beyond that.
BROADCAST_BYTES = 64 << 20
SALTS = 64


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, hot: int | None = None, total: int | None = None) -> DataFrame:
    """rows left-joined with groups (one row for each key), where a few keys may hold most of the rows.

    size names the column of groups with the number of rows of a key; key is a string column. Keys with
    at least one in `hot` of all counted rows (by default the session's shuffle partitions, 256 at least) are `hot` at most. Their groups are
    broadcast if all of their columns come to BROADCAST_BYTES at most, and repeated for SALTS parts of their rows otherwise; only if the hot
    keys alone are longer than that, nothing is told apart. The others are shuffled by their key, rows that are matched by then by the column spread.

    total: no less than the sum of all sizes, where a caller knows it, rows are a table and groups' keys and columns are short (numbers); then
    nothing is counted or measured first, and rows of hot keys aren't shuffled at all.
    """
    hot = hot or max(256, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in groups.columns if c != key]
    if total is not None:
        named = groups.withColumnRenamed(key, "_key")
        often = F.broadcast(named.where(F.col(size) * hot >= total))
        same = F.col(key) == F.col("_key")
        apart = rows.join(often, same).select(*rows.columns, *own)
        others = rows.join(often.select("_key"), same, "left_anti").join(named.where(F.col(size) * hot < total), same, "left")
        return apart.unionByName(others.select(*rows.columns, *own))
    total = groups.agg(F.sum(size)).first()[0] or 0
    many = groups.where(F.col(size) * hot >= total)
    keys, whole = many.agg(F.sum(F.octet_length(key)), F.sum(F.octet_length(F.to_json(F.struct(*groups.columns))))).first()
    if keys is None or keys > BROADCAST_BYTES:
        return rows.join(groups, key, "left").select(*rows.columns, *own)
    rest = groups.where(F.col(size) * hot < total).select(F.col(key).alias("_key"), *own)
    salt = F.xxhash64(spread)
    if (whole or 0) > BROADCAST_BYTES:
        part = lambda c: F.concat(F.lit("~"), c.cast("string"), F.lit(":"), F.col(key))
        parts = many.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")).select(part(F.col("_salt")).alias("_key"), *own)
        found = rows.join(F.broadcast(many.select(key, F.lit(True).alias("_hot"))), key, "left")
        found = found.withColumn("_key", F.when(F.col("_hot"), part(F.pmod(salt, F.lit(SALTS)))).otherwise(F.concat(F.lit("="), key)))
        every = parts.unionByName(rest.withColumn("_key", F.concat(F.lit("="), "_key")))
        return found.join(every, "_key", "left").select(*rows.columns, *own)
    often = many.select(key, *(F.col(c).alias(f"_hot_{c}") for c in own), F.lit(True).alias("_hot"))
    found = rows.join(F.broadcast(often), key, "left")
    dealt = F.when(F.col("_hot"), F.concat(F.lit("~"), salt.cast("string"))).otherwise(F.col(key))
    found = found.withColumn("_key", dealt).join(rest, "_key", "left")
    return found.select(*rows.columns, *(F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in own))


#: Rows to drop up to this many are broadcast; more are joined through a shuffle.
BROADCAST_ROWS = 200_000


def row_key(id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> Column:
    """A key of a row's id, text and further columns, also where they are null or the id repeats."""
    rest = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("~")) for c in more]
    parts = [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("~")), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256), *([F.sha2(F.to_json(F.array(*rest)), 256)] if rest else [])]
    return F.concat_ws(":", *parts)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have (names differ in more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """docs without the rows whose key is in dropped, a table of one column. A checked small number of keys is broadcast, so that texts stay where they are. Inside `passing`, their table is kept."""
    name = free_name(docs, "drop")
    dropped = written(dropped.toDF(name).distinct(), "dropped", keep=True)
    few = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, key == F.col(name), "left_anti")
