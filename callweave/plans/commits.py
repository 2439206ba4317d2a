"""Versions of tables in a folder: a small manifest, written last, says which files are a version; readers follow the newest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/commits")
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, manifest) of the newest version; 0 and nothing if there is none."""
    _, folder, files = _files(spark, path)
    if not files.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
    return (number, json.loads(spark.read.text(f"{folder}/{number}.json", wholetext=True).first()[0])) if number else (0, {})


def commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Make a version visible at once. If someone else has committed that number meanwhile, this fails and changes nothing."""
    jvm, folder, files = _files(spark, path)
    made = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = files.create(made, False)
    out.write(json.dumps(manifest).encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, jvm.org.apache.hadoop.fs.Path(folder, f"{number}.json"), options)


def unused(path: str) -> str:
    """A new folder for the files of a version that isn't committed yet."""
    return f"{path.rstrip('/')}/data-{uuid.uuid4().hex}"


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a path or glob stands for; none if nothing is there."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(pattern)
    return [s.getPath().toString() for s in glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []]
