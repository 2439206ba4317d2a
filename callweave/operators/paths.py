"""Regular simple paths: node sequences without repeats that an automaton, or a pattern of selections, accepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CallGraph
from ..plans.tables import counted, fixpoint, written
from .automata import ANY, Alt, Automaton, One, Pattern, Seq, Star, Table, automaton, classified

__all__ = ["ANY", "Alt", "Automaton", "One", "Pattern", "Seq", "Star", "automaton", "paths", "printed"]

#: Paths at most in a front that is grown several nodes in one job.
SMALL_FRONT = 1 << 15
HOPS = 4


def _live(nodes: DataFrame, edges: DataFrame, table: Table) -> DataFrame:
    """(id, state): nodes and states after them from which some walk ends well; walks bound what paths can do.

    A backward fixpoint over edges and moves, both ways round at once.
    """
    enters = table.moves.select("cls", F.col("next").alias("state")).distinct()
    ends = nodes.select("id", "cls").join(enters.where(table.ends(F.col("state"))), "cls").select("id", "state")
    back = edges.select("src", "src_cls", F.col("dst").alias("id"), F.col("dst_cls").alias("cls"))
    moves = table.moves.select("cls", F.col("state").alias("before"), F.col("next").alias("state"))
    possible = enters.select(F.col("cls").alias("src_cls"), F.col("state").alias("before"))

    def step(front: DataFrame) -> DataFrame:
        found = front.join(back, "id").join(moves, ["cls", "state"])
        return found.join(possible, ["src_cls", "before"], "left_semi").select(F.col("src").alias("id"), F.col("before").alias("state"))

    return fixpoint(ends, step)


def paths(graph: CallGraph, pattern: Pattern | Automaton, external_ok: bool = False, ref_ok: bool = False, limit: int | None = None, most_nodes: int | None = None) -> DataFrame:
    """(path, length): all simple paths over visible nodes whose whole sequence is accepted, as names from the first to the last.

    The automaton is determinised over the classes of nodes that its selections tell apart, so a path is one row however many ways it matches; one that
    would grow too large for that keeps its own states, and paths are made distinct at the end. Pairs of a node and a state that lead to no end are
    cut beforehand, what is left is one table of steps. Paths are grown from all starts at once. limit keeps the shortest paths (ties by names) and stops
    early; most_nodes raises an error if paths would grow beyond it, rather than cut them off.
    """
    spark = graph.spark
    own = automaton(pattern)
    empty = "path array<string>, length int"
    if (limit is not None and limit <= 0) or not own.moves:
        return spark.createDataFrame([], empty)
    nodes, table = classified(own, graph)
    nodes = nodes.where(F.col("shown") & (F.lit(True) if external_ok else ~F.col("external"))).select("id", "name", "cls")
    edges = graph.open_edges() if ref_ok else graph.open_edges().where("is_call")
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("cls").alias(f"{side}_cls"))
    edges = written(edges.select("src", "dst").where("src <> dst").join(end("src"), "src").join(end("dst"), "dst"), "edges")
    live = _live(nodes, edges, table)
    arrive = live.select(F.col("id").alias("dst"), F.col("state").alias("next"))
    moves = table.moves.select(F.col("cls").alias("dst_cls"), "state", "next")
    steps = edges.join(live.withColumnRenamed("id", "src"), "src").join(moves, ["dst_cls", "state"]).join(arrive, ["dst", "next"], "left_semi")
    steps = written(steps.select(F.col("src").alias("at"), "state", "dst", "next"), "steps")

    start = table.moves.where(F.col("state").isin(table.start)).select("cls", F.col("next").alias("state")).distinct()
    front = nodes.join(start, "cls").join(live, ["id", "state"], "left_semi").select(F.array("id").alias("ids"), F.col("id").alias("at"), "state")
    front, seen = counted(front, "front")
    done, count, size = [front], 0, 1
    ended = F.count_if(table.ends(F.col("state")))
    if limit is not None:
        count = front.where(table.ends(F.col("state"))).count()
    grown = seen["n"]
    while grown and not (limit is not None and count >= limit):
        if most_nodes is not None and size >= most_nodes:
            raise ValueError(f"paths of more than {most_nodes} nodes")
        hops = HOPS if grown <= SMALL_FRONT else 1
        hops = hops if most_nodes is None else min(hops, most_nodes - size)
        levels = [front]
        for _ in range(hops):
            found = levels[-1].join(steps, ["at", "state"]).where(~F.array_contains("ids", F.col("dst")))
            levels.append(found.select(F.concat("ids", F.array("dst")).alias("ids"), F.col("dst").alias("at"), F.col("next").alias("state")))
        made, seen = counted(reduce(DataFrame.unionByName, levels[1:]), "front", last=F.count_if(F.size("ids") == size + hops), ended=ended)
        size += hops
        front, grown, count = made.where(F.size("ids") == size), seen["last"], count + seen["ended"]
        done.append(made)
    found = reduce(DataFrame.unionByName, done).where(table.ends(F.col("state"))).select("ids")
    found = found if table.whole else written(found.distinct(), "paths")
    found = found.withColumn("n", F.monotonically_increasing_id())
    steps_of = found.select("n", F.posexplode("ids").alias("k", "id")).join(nodes.select("id", "name"), "id")
    named = steps_of.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda s: s["name"]).alias("path"))
    out = named.select("path", F.size("path").alias("length"))
    return out if limit is None else out.orderBy("length", "path").limit(limit)


def printed(found: DataFrame) -> DataFrame:
    """(path, length) with paths as text, the last node first."""
    return found.select(F.array_join(F.reverse("path"), " <- ").alias("path"), "length")
