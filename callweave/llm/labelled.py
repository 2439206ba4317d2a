"""Bounded samples of labelled documents, and the logistic regression that is fitted to them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a training example, and of all of them, at most; longer texts are scored like others.
LONGEST_EXAMPLE = 32_000
SAMPLE_BYTES = 64 << 20


def fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; fold 0 is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most per_class documents of each label 0 and 1, and SAMPLE_BYTES of text, half of it for each label: id, label and text.

    Documents are taken in the order of their ids' hashes. Rows of fold 0, null ids and rows without a label are left
    out; an id labelled twice has the larger label, one that repeats with several texts the least of them. The ids sent to the
    executors are bounded by per_class, the texts chosen also by their bytes.
    """
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(fold("id") != 0)
    own = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST_EXAMPLE)
    found = texts.join(F.broadcast(reduce(DataFrame.unionByName, own)), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    return found.withColumn("bytes", so_far).where(F.col("bytes") <= SAMPLE_BYTES // 2).select("id", "label", "text")


def examples(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """The sample's id, label and text, brought to the driver, by id."""
    return sample(docs, labels, label, per_class, id_col, text_col).toArrow().sort_by([("id", "ascending")])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w
