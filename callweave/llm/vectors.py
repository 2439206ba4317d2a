"""Vectors of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers larger than this aren't exact in a double, so their floor says nothing.
MOST = 1 << 52


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, size: int | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(id, v, more): floor(scale * x) of each component, x as double, as longs.

    Vectors that are null, hold null or non-finite components, or, if size is given, have another number of components are left out;
    ids may be null or repeat. Scaled components beyond MOST raise an error.
    """
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v"), *(c.alias(n) for n, c in (more or {}).items()))
    wanted = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(wanted if size is None else wanted & (F.size("v") == size))

    def whole(c: Column) -> Column:
        return F.when(F.abs(c * scale) <= MOST, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact sums")).cast("long"))

    return rows.withColumn("v", F.transform("v", whole))
