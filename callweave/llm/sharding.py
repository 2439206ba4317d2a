"""Documents in shards of regions and racks, chosen by weighted hash draws down a tree; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import parts_for


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. branch tells shards that joined a region later from those it began with."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0
    branch: int = 0


def grid(regions: int, racks: int, each: int) -> tuple[Shard, ...]:
    """regions of so many racks of so many shards, all of one weight."""
    return tuple(Shard((a * racks + b) * each + c, f"region-{a}", f"rack-{b}") for a in range(regions) for b in range(racks) for c in range(each))


def joined(layout: Sequence[Shard], region: str, rack: str, weight: float = 1.0) -> tuple[Shard, ...]:
    """layout with one more shard.

    It stands in a region and rack, but is drawn against the other regions as a branch of its own: were it drawn inside its region, rows that
    the region's new weight brings in would also go to that region's old shards. So it takes rows only into itself.
    """
    return (*layout, Shard(max((s.shard for s in layout), default=-1) + 1, region, rack, weight, max((s.branch for s in layout), default=-1) + 1))


def _uniform(key: Column, path: Column) -> Column:
    """A number inside (0, 1) from the upper 53 bits of a hash of the row's key and a node's path."""
    return (F.shiftrightunsigned(F.xxhash64(key, path), 11).cast("double") + 0.5) / float(1 << 53)


def _drawn(key: Column, children: Column) -> Column:
    """The child with the least draw -ln(u) / weight: each wins as often as its share of the weights, and one whose
    weight alone changes only wins rows from the others, or loses some to them."""
    draws = F.transform(children, lambda c: F.struct((-F.log(_uniform(key, c["path"])) / c["weight"]).alias("draw"), c["place"].alias("place")))
    return F.array_min(draws)["place"]


def _children(groups: list[list[tuple[str, float, int]]]) -> Column:
    """An array of the children (path, weight, place) of each node of a level."""
    return F.array(*(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(n).alias("place")) for p, w, n in g)) for g in groups))


def placed(key: Column, layout: Sequence[Shard]) -> Column:
    """The shard of a row's key: drawn region by region, then rack by rack of that region, then shard by shard of that rack.

    Draws depend on the key, the node and its weight alone. If weights of one subtree change, rows move only into it or out of it,
    and inside it, along the changed nodes; all other subtrees keep what they have. A null key is a key like others.
    """
    if not layout or any(not s.weight > 0 for s in layout) or len({s.shard for s in layout}) < len(layout):
        raise ValueError("a layout needs shards with different numbers and weights over 0")
    tree: dict[str, dict[str, list[Shard]]] = {}
    for s in sorted(layout, key=lambda s: s.shard):
        top = f"{s.branch}/{s.region}"
        tree.setdefault(top, {}).setdefault(f"{top}/{s.rack}", []).append(s)
    racks = [(path, shards) for region in tree.values() for path, shards in region.items()]
    weigh = lambda shards: sum(s.weight for s in shards)
    place_of = {path: i for i, (path, _) in enumerate(racks)}
    top = _children([[(path, sum(map(weigh, own.values())), i) for i, (path, own) in enumerate(tree.items())]])
    middle = _children([[(path, weigh(shards), place_of[path]) for path, shards in own.items()] for own in tree.values()])
    low = _children([[(f"{path}/{s.shard}", s.weight, s.shard) for s in shards] for path, shards in racks])
    key = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("~"))
    region = _drawn(key, F.get(top, F.lit(0)))
    rack = _drawn(key, F.get(middle, region))
    return _drawn(key, F.get(low, rack))


def write_shards(docs: DataFrame, path: str, layout: Sequence[Shard], id_col: str = "doc_id") -> None:
    """Write whole rows as Parquet, a folder `shard=N` for each shard that has any, in files of about one partition's size.

    The id and the layout decide on a row's shard. Within a shard rows are in the order of a hash of their id, so a shard is read in an
    order that says nothing; place tells each row's partition and number there. One range shuffle deals rows by shard, hash and
    input row, so that no shard, repeated id or group of copies lands in one task. A row's own columns
    are kept inside the column `row`, whatever their names. Null ids share a shard; no rows give an empty folder.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    key = F.col(f"`{id_col}`")
    rows = docs.select(own, placed(key, layout).alias("shard"), F.xxhash64(key.cast("string")).alias("order"), F.monotonically_increasing_id().alias("line"))
    dealt = rows.repartitionByRange(parts_for(docs), "shard", "order", "line").sortWithinPartitions("shard", "order", "line")
    dealt.select("row", F.monotonically_increasing_id().alias("place"), "shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType, row: Sequence[str] | None = None) -> DataFrame:
    """(row, shard, slot) of what `write_shards` wrote from documents of this schema; slots are gapless from 0 in each shard.

    row: the columns to read, all by default. A partition holds neighbouring places of a shard, so a slot is the place in it after the shard's
    rows of earlier partitions. Those counts are one row for each partition and shard in it, so partitions plus shards in number, which is what is broadcast.
    """
    kinds = [f for f in schema if row is None or f.name in row]
    files = spark.read.schema(StructType().add("row", StructType(kinds)).add("place", "long").add("shard", "integer")).parquet(path)
    part = F.shiftright("place", 33)
    runs = files.groupBy(part.alias("part"), "shard").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "shard", "first", F.coalesce(before, F.lit(0)).alias("before"))
    found = files.withColumn("part", part).join(F.broadcast(runs), ["part", "shard"])
    return found.select("row", "shard", (F.col("place") - F.col("first") + F.col("before")).alias("slot"))


def digests(spark: SparkSession, path: str, schema: StructType, grown: Sequence[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document in the shards: id, size (bytes of the text, null: none, plus 16), text_crc32 (null as empty), law, shard,
    slot, and grown_shard, its shard in the layout `grown`. Repeated rows are rows like others; no rows give no rows."""
    found = read_shards(spark, path, schema, [id_col, text_col])
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    own = F.col(f"row.`{id_col}`")
    return found.select(own.alias(id_col), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", placed(own, grown).alias("grown_shard"))
