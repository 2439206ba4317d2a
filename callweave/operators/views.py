"""Commands that change what the view shows. Each returns a new graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import MARKS, CallGraph
from ..plans.tables import written
from .closure import all_callees, all_callers
from .neighbours import callees, callers

_MARKS = ("keep", "omitted", "no_callers", "no_callees")


def _mark(graph: CallGraph, ids: DataFrame, **marks: bool) -> CallGraph:
    """marks set on ids; later marks replace earlier ones."""
    old = graph.marks if graph.marks is not None else graph.spark.createDataFrame([], MARKS)
    new = ids.select("id").distinct().withColumns({f"new_{k}": F.lit(marks.get(k)).cast("boolean") for k in _MARKS})
    both = old.join(new, "id", "full").select("id", *(F.coalesce(f"new_{k}", k, F.lit(False)).alias(k) for k in _MARKS))
    return replace(graph, marks=written(both, "marks"))


def omit_nodes(graph: CallGraph, ids: DataFrame) -> CallGraph:
    return _mark(graph, ids, omitted=True, keep=False)


def keep_nodes(graph: CallGraph, ids: DataFrame) -> CallGraph:
    """Shown from now on, whatever the default; hidden edges stay hidden."""
    return _mark(graph, ids, keep=True, omitted=False)


def _omit_isolated(graph: CallGraph, ids: DataFrame) -> CallGraph:
    """Omit those of ids that no open edge joins to a visible node."""
    linked = callers(graph, ids, ref_ok=True).select(F.col("dst").alias("id")).unionByName(callees(graph, ids, True, True).select(F.col("src").alias("id")))
    return omit_nodes(graph, ids.join(linked.distinct(), "id", "left_anti"))


def omit_callers_of(graph: CallGraph, ids: DataFrame) -> CallGraph:
    """Hide all edges into ids, and then what of ids and their callers that leaves alone.

    All edges are hidden before anything is judged, so the outcome doesn't depend on an order of the nodes.
    """
    ids = written(ids.select("id").distinct(), "targets")
    hidden = _mark(graph, ids, no_callers=True)
    near = graph.edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return _omit_isolated(hidden, written(ids.unionByName(near).distinct(), "near"))


def omit_callees_of(graph: CallGraph, ids: DataFrame) -> CallGraph:
    """Hide all edges out of ids, and then what of ids and their callees that leaves alone."""
    ids = written(ids.select("id").distinct(), "targets")
    hidden = _mark(graph, ids, no_callees=True)
    near = graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return _omit_isolated(hidden, written(ids.unionByName(near).distinct(), "near"))


def omit(graph: CallGraph, ids: DataFrame, callers: bool = False, callees: bool = False) -> CallGraph:
    """Omit nodes; with a flag, instead hide the edges into (out of) everything that calls (is called by) them."""
    if not callers and not callees:
        return omit_nodes(graph, ids)
    out = graph
    if callers:
        out = omit_callers_of(out, all_callers(graph, ids))
    if callees:
        out = omit_callees_of(out, all_callees(graph, ids))
    return out


def keep(graph: CallGraph, ids: DataFrame, callers: bool = False, callees: bool = False) -> CallGraph:
    """Keep nodes, and with a flag all their direct and indirect callers (callees)."""
    if callers:
        ids = ids.select("id").unionByName(all_callers(graph, ids))
    if callees:
        ids = ids.select("id").unionByName(all_callees(graph, ids))
    return keep_nodes(graph, ids)


def only(graph: CallGraph, ids: DataFrame, callers: bool = False, callees: bool = False) -> CallGraph:
    """Show nothing but what is kept; ids are chosen in the view before the change. Repeated calls add up."""
    return keep(replace(graph, default=False), ids, callers, callees)
