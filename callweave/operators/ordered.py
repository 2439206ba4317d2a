"""Order without one task that sees everything: numbering, filling forward, and joins with what came before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import counted, written


def _dealt(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df as a table whose partitions follow one another in the order; at ascends within and across them."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.withColumn("at", F.monotonically_increasing_id()), "dealt").withColumn("part", F.shiftright("at", 33))


def offset(df: DataFrame, order: Sequence[str], amount: str, name: str, first: int = 0) -> DataFrame:
    """df with name: `first` and the sum of amount over all rows before, in the order. Only one row for each partition meets in one place."""
    rows = _dealt(df, order)
    up_to = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum(amount).alias("n"))
    parts = parts.select("part", (F.coalesce(F.sum("n").over(up_to.orderBy("part")), F.lit(0)) + first).alias("shift"))
    own = F.coalesce(F.sum(amount).over(up_to.partitionBy("part").orderBy("at")), F.lit(0))
    return rows.withColumn("own", own).join(F.broadcast(parts), "part").withColumn(name, F.col("own") + F.col("shift")).select(*df.columns, name)


def numbered(df: DataFrame, order: Sequence[str], name: str, first: int = 0) -> DataFrame:
    """df with its rows' places in the order, gapless from `first`."""
    return offset(df.withColumn("one", F.lit(1)), order, "one", name, first).drop("one")


def carried(rows: DataFrame, key: str, part: str, order: Sequence[str], value: str) -> DataFrame:
    """rows with value filled forward: of each key the last one, up to the row, that isn't null.

    rows is a written table; part, ascending along the order, cuts a key's rows into pieces that a task can hold. A window fills each piece, the
    pieces' last values are carried into later ones: one row for each piece, and only those that begin without a value of their own are joined.
    """
    own = Window.partitionBy(key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(key, part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("end"))
    before = F.last("end", True).over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(key, part, before.alias("_carried")).where("_carried is not null")
    filled = rows.withColumn(value, F.last(value, True).over(own)).join(carry, [key, part], "left")
    return filled.withColumn(value, F.coalesce(value, "_carried")).drop("_carried")


class Events:
    """events (alias, ord, symbol), summed up by alias for any number of joins."""

    def __init__(self, events: DataFrame):
        self.events = events
        kinds = events.groupBy("alias").agg(F.count("*").alias("_n"), F.min("ord").alias("_since"), F.min_by("symbol", "ord").alias("_symbol"))
        self.kinds, seen = counted(kinds, "aliases", several=F.count_if(F.col("_n") > 1))
        self.several = self.kinds.where("_n > 1").select("alias")
        self.none, self.single = not seen["n"], not seen["several"]


def as_of(rows: DataFrame, events: Events, on: str, name: str, order: str = "ord") -> DataFrame:
    """rows with column `name`: the symbol of the last event whose alias is `on` and which came before the row; null if none.

    Most aliases have one event, which a plain join brings. Rows of an alias with several are sorted in with its events over range partitions
    and filled forward, so a name that a large share of all rows use lies on many tasks.
    """
    if events.none:
        return rows.withColumn(name, F.lit(None).cast("string"))
    found = rows.join(events.kinds.withColumnRenamed("alias", on), on, "left")
    plain = found.withColumn(name, F.when(F.col("_since") < F.col(order), F.col("_symbol")))
    if events.single:
        return plain.select(*rows.columns, name)
    one = plain.where("_n is null or _n = 1").select(*rows.columns, name)
    asked = found.where("_n > 1").select(F.col(on).alias("key"), F.col(order).alias("when"), F.lit(0).alias("event"), F.lit(None).cast("string").alias("value"), F.struct(*rows.columns).alias("row"))
    told = events.events.join(events.several, "alias", "left_semi").select(F.col("alias").alias("key"), F.col("ord").alias("when"), F.lit(1).alias("event"), F.col("symbol").alias("value"))
    both = _dealt(asked.unionByName(told, allowMissingColumns=True), ["key", "when", "event"])  # at the same time, the row goes first
    late = carried(both, "key", "part", ["at"], "value").where("event = 0").select("row.*", F.col("value").alias(name))
    return one.unionByName(late)
