"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary folder only where that is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "table", **more) -> tuple[DataFrame, dict[str, int]]:
    """df as a table, with its rows' number n and further sums (column expressions), taken while it is written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items())), name)
    return out, seen.get


#: A front of at most so many rows is taken several steps further in one job, as the job's own cost outweighs what is visited twice.
SMALL_FRONT = 1 << 17
HOPS = 4


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], small: int = SMALL_FRONT, hops: int = HOPS) -> DataFrame:
    """The distinct rows of start and all that step leads to from them, again and again.

    Semi-naive: a round takes the rows that the last one added. Each round is a table in the shared folder, so a lost executor costs a round at
    most. Rounds from a small front go several steps at once, from a large one a single step. A row is what its columns say.
    """
    columns = start.columns
    front, seen_of = counted(start.distinct(), "front")
    seen = [front]
    while seen_of["n"]:
        levels = [front]
        for _ in range(hops if seen_of["n"] <= small else 1):
            levels.append(step(levels[-1]).select(*columns).distinct())
        tagged = [df.withColumn("hop", F.lit(-k)) for k, df in enumerate(levels)][1:]
        found = tagged[0] if len(tagged) == 1 else reduce(DataFrame.unionByName, tagged).groupBy(*columns).agg(F.max("hop").alias("hop"))
        known = reduce(DataFrame.unionByName, seen)
        news, seen_of = counted(found.join(known, columns, "left_anti"), "front", last=F.count_if(F.col("hop") == 1 - len(levels)))
        seen.append(news.select(*columns))
        # What fewer hops reached was taken further in this round already.
        front, seen_of = news.where(F.col("hop") == 1 - len(levels)).select(*columns), {"n": seen_of["last"]}
        if len(seen) > 8:
            seen = [written(reduce(DataFrame.unionByName, seen), "seen")]
    return reduce(DataFrame.unionByName, seen)
