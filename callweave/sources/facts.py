"""Facts about a call graph, in the order of their arrival, and the tables that they amount to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CallGraph
from ..operators.ordered import Events, as_of, numbered
from ..plans.tables import counted, written

#: kind: node, edge or label. name: the node, or an edge's caller; target: the callee; is_call: call, else ref.
#: checked: as a command line does, an edge needs a caller that is defined by then, and a label a node that is there by then.
FACTS = "ord long, kind string, name string, username string, file string, line int, external boolean, target string, is_call boolean, label string, checked boolean"
#: created and defined, called: the ord of the first fact that names a node or edge, and of the one that defines it or makes it a call (null: none).
NODE_HISTORY = "id long, name string, username string, file string, line int, created long, defined long"
EDGE_HISTORY = "src long, dst long, created long, called long"
LABEL_HISTORY = "id long, label string, created long"
#: From ord on, an alias stands for the node with that symbol.
ALIASES = "alias string, ord long, symbol string"
#: What was refused, where and why. line counts from 1 and is null where a whole file was refused.
REJECTS = "ord long, file string, line long, reason string"


def facts(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A few facts by hand; ord is their place unless given."""
    names = [f.split()[0] for f in FACTS.split(", ")]
    return spark.createDataFrame([tuple(({"ord": i, "external": False, "is_call": True, "checked": False} | r).get(n) for n in names) for i, r in enumerate(rows)], FACTS)


@dataclass(frozen=True)
class History:
    """The nodes, edges and labels of facts with the times at which they came about, new aliases, and the refused facts.

    Of a history that goes on from an earlier one, nodes are those that are new or newly defined, edges and labels those of the new facts.
    """

    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame
    aliases: DataFrame
    rejects: DataFrame
    #: The last fact's ord and the largest of nodes' ids, null if there are none.
    last: int | None = None
    top: int | None = None

    def at(self, ord: int | None = None) -> CallGraph:
        """The graph of the facts before ord, all by default: a filter over the same tables."""
        by = lambda c: F.col(c).isNotNull() if ord is None else F.coalesce(F.col(c) < ord, F.lit(False))
        known = lambda c: F.when(by("defined"), F.col(c)).alias(c)
        nodes = self.nodes.where(by("created")).select("id", "name", known("username"), known("file"), known("line"), (~by("defined")).alias("external"))
        edges = self.edges.where(by("created")).select("src", "dst", by("called").alias("is_call"))
        return CallGraph(nodes, edges, self.labels.where(by("created")).select("id", "label"))


def _first_definitions(defs: DataFrame) -> DataFrame:
    return defs.groupBy("symbol").agg(F.min("ord").alias("defined"), F.min_by(F.struct("username", "file", "line"), "ord").alias("d")).select("symbol", "defined", "d.*")


def history(found: DataFrame, known: Callable[[DataFrame], DataFrame] | None = None, told: Callable[[DataFrame], DataFrame | None] | None = None, next_id: int = 0) -> History:
    """What a batch of facts (FACTS) adds to a graph, empty by default.

    A name stands, at its own place among the facts, for the node that was last defined with that pretty name before, else for the symbol of the same
    spelling. The first definition of a node counts; what is only referred to is external. A call replaces a reference between the same
    nodes. Ids ascend from next_id, without gaps, in the order of the facts that first name the nodes (an edge's caller before its callee).

    known gives the rows (NODE_HISTORY) of symbols (symbol) in the graph so far, told the pretty names (ALIASES) among names (alias), if it has any; all facts are
    later than those.
    """
    spark = found.sparkSession
    found, seen = counted(found, "facts", last=F.max("ord"))
    named = found.select(F.explode(F.array("name", "target")).alias("alias")).where("alias is not null").distinct()
    aliases = told(named) if told else None
    # All that names can come to stand for: themselves, and what old pretty names stand for.
    old = spark.createDataFrame([], NODE_HISTORY)
    if known is not None:
        asked = named.withColumnRenamed("alias", "symbol")
        asked = asked if aliases is None else asked.unionByName(aliases.select("symbol")).distinct()
        old = written(known(asked), "known")

    def symbols(df: DataFrame, column: str, events: Events) -> DataFrame:
        return df if events.none else as_of(df, events, column, "_symbol").withColumn(column, F.coalesce("_symbol", column)).drop("_symbol")

    # A definition's own name may be another's pretty name, which takes it out of the definitions that count; every round settles the
    # earliest of those at least, and mostly there are none.
    defs = found.where("kind = 'node' and not external").select("ord", "name", "username", "file", "line").withColumn("symbol", F.col("name"))
    before = old.where("defined is not null").select(F.col("name").alias("symbol"))
    defs = written(symbols(defs, "symbol", Events(aliases)), "definitions") if aliases is not None else defs
    while True:
        first = written(_first_definitions(defs).join(before, "symbol", "left_anti"), "first")
        news = first.where("username is not null").select(F.col("username").alias("alias"), F.col("defined").alias("ord"), "symbol")
        events = Events(news if aliases is None else news.unionByName(aliases))
        if events.none:
            break
        moved = symbols(defs.withColumn("was", F.col("symbol")).withColumn("symbol", F.col("name")), "symbol", events)
        moved, change = counted(moved, "definitions", moved=F.count_if(F.col("symbol") != F.col("was")))
        defs = moved.drop("was")
        if not change["moved"]:
            break

    edges = symbols(symbols(found.where("kind = 'edge'").select("ord", "name", "target", "is_call", "checked"), "name", events), "target", events)
    labels = symbols(found.where("kind = 'label'").select("ord", "name", "label", "checked"), "name", events)
    others = symbols(found.where("kind = 'node' and external").select("ord", "name"), "name", events)
    if not events.none:
        edges, labels = written(edges, "edge-facts"), written(labels, "label-facts")

    checked = F.coalesce(F.col("checked"), F.lit(False))
    defined = first.select("symbol", "defined").unionByName(old.where("defined is not null").select(F.col("name").alias("symbol"), "defined"))
    judged = written(edges.join(defined.withColumnRenamed("symbol", "name"), "name", "left").withColumn("fits", ~checked | F.coalesce(F.col("defined") < F.col("ord"), F.lit(False))), "judged")
    edges = judged.where("fits").select("ord", "name", "target", "is_call")

    names = defs.select("symbol", "ord", F.lit(0).alias("slot")).unionByName(others.select(F.col("name").alias("symbol"), "ord", F.lit(0).alias("slot")))
    for df, column, slot in ((edges, "name", 0), (edges, "target", 1), (labels.where(~checked), "name", 0)):
        names = names.unionByName(df.select(F.col(column).alias("symbol"), "ord", F.lit(slot).alias("slot")))
    made = names.groupBy("symbol").agg(F.min(F.struct("ord", "slot")).alias("m")).select("symbol", F.col("m.ord").alias("created"), F.col("m.slot").alias("slot"))
    made = made.join(old.select(F.col("name").alias("symbol")), "symbol", "left_anti").join(first, "symbol", "left")
    made = numbered(made, ["created", "slot", "symbol"], "id", next_id)
    fresh = made.select("id", F.col("symbol").alias("name"), "username", "file", "line", "created", "defined")
    late = old.where("defined is null").select("id", "name", "created").join(first.withColumnRenamed("symbol", "name"), "name").select("id", "name", "username", "file", "line", "created", "defined")
    nodes, top = counted(fresh.unionByName(late), "nodes", top=F.max("id"))

    ids = nodes.select("name", "id", F.col("created").alias("since"))
    if known is not None:  # newly defined nodes are among the old ones too
        ids = written(ids.unionByName(old.select("name", "id", F.col("created").alias("since"))).distinct(), "ids")
    refused = judged.where("not fits").join(ids.select("name", "since"), "name", "left")
    why = F.when(F.col("since") < F.col("ord"), F.concat(F.lit("cannot add edge from external node: "), "name")).otherwise(F.concat(F.lit("caller not found in graph: "), "name"))
    rejects = refused.select("ord", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), why.alias("reason"))

    edges = edges.groupBy("name", "target").agg(F.min("ord").alias("created"), F.min(F.when(F.col("is_call"), F.col("ord"))).alias("called"))
    edges = edges.join(ids.select("name", F.col("id").alias("src")), "name").join(ids.select(F.col("name").alias("target"), F.col("id").alias("dst")), "target").select("src", "dst", "created", "called")
    labels = labels.join(ids, "name").where(~checked | (F.col("since") < F.col("ord"))).groupBy("id", "label").agg(F.min("ord").alias("created"))
    return History(nodes, written(edges, "edges"), written(labels, "labels"), news, rejects, seen["last"], top["top"])


def build(found: DataFrame) -> CallGraph:
    """The graph of a batch of facts; `history` says how."""
    return history(found).at()


def rejected(found: DataFrame) -> DataFrame:
    """(ord, file, line, reason): what a command line refuses: edges whose caller isn't defined by an earlier fact, and external nodes with a file."""
    place: list[Column] = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line")]
    filed = found.where("kind = 'node' and external and file is not null").select("ord", *place, F.lit("file not allowed for external symbols").alias("reason"))
    return history(found.withColumn("checked", F.lit(True))).rejects.unionByName(filed)
