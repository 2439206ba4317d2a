"""Everything that can be reached from some nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CallGraph
from ..plans.tables import fixpoint, written


def reach(edges: DataFrame, start: DataFrame, backwards: bool = False) -> DataFrame:
    """(id): the start nodes and all that edges (src, dst) lead to, or come from.

    Semi-naive rounds (see `fixpoint`) join the nodes that the last one added with the edges, which are written once.
    """
    near, far = ("dst", "src") if backwards else ("src", "dst")
    steps = written(edges.select(F.col(near).alias("id"), F.col(far).alias("next")), "steps")
    return fixpoint(start.select("id"), lambda front: front.join(steps, "id").select(F.col("next").alias("id")))


def all_callees(graph: CallGraph, ids: DataFrame) -> DataFrame:
    """(id): the nodes and all that they reach over calls and references, whatever the view hides."""
    return reach(graph.edges, ids)


def all_callers(graph: CallGraph, ids: DataFrame) -> DataFrame:
    """(id): the nodes and all that reach them over calls and references, whatever the view hides."""
    return reach(graph.edges, ids, backwards=True)
