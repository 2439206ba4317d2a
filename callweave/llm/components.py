"""Connected components of links, as rounds of joins and groupings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import join_runs
from .common import passing, written

#: Links that a task joins to stars at once.
AT_ONCE = 1 << 18


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from each of some links' ids to the least that they connect it with; they connect what the links do."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        ends = np.concatenate([batch.column(c).to_numpy() for c in ("u", "v") for batch in waiting])
        ids, at = np.unique(ends, return_inverse=True)
        least = join_runs(len(ids), at[: len(at) // 2], at[len(at) // 2 :])
        moved = np.flatnonzero(least != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[least[moved]])], names=["u", "v"])

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= AT_ONCE:
            yield joined()
            waiting.clear()
    if waiting:
        yield joined()


def _least(links: DataFrame) -> DataFrame:
    """(u, least, degree, below): for every u, the least of it and its neighbours v, how many it has and how many are smaller. A table."""
    return written(links.groupBy("u").agg(F.least("u", F.min("v")).alias("least"), F.count("*").alias("degree"), F.count_if(F.col("v") < F.col("u")).alias("below")), "least")


def _nearest(links: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, least): every link seen from u, with the least of u and its neighbours.

    The least was found by grouping with map-side combining; it is a table, so that Spark splits the partition of a node with a large share of the links.
    """
    return links.join(least.select("u", "least"), "u")


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): for every id in the links (a, b), the smallest id that they connect it with.

    Each task first joins its own links to stars. Then two steps alternate until all links are stars: larger neighbours are linked to the
    least neighbour, then smaller ones. Links only shrink towards stars, in a number of rounds logarithmic in the longest
    chain; every round is a table in the shared folder, deleted once the result, itself a table there, is written. Ids are of an integer type. Links with a null end
    and links of an id with itself say nothing and are dropped; no links give no rows.
    """
    with passing(links.sparkSession):
        return written(_settled(links, most_rounds), "components", keep=True)


def _settled(links: DataFrame, most_rounds: int) -> DataFrame:
    links = links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"), "a", "b").where("a <> b").select("u", "v").distinct()
    links = written(links.mapInArrow(_stars, links.schema), "links")
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        # In stars, whoever has a smaller neighbour has no other.
        if least.where("below > 0 and degree > 1").isEmpty():
            return least.select(F.col("u").alias("id"), F.col("least").alias("component"))
        links = _nearest(both, least).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        links = written(links, "links")
        near = _nearest(links, _least(links)).select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
        links = written(near.where("u <> v").distinct(), "links")
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
