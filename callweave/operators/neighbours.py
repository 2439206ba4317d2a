"""One-hop neighbours under the view, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display
from ..graph import CallGraph


def _ends(graph: CallGraph, side: str) -> DataFrame:
    return graph.viewed().select(F.col("id").alias(side), F.col("external").alias(f"{side}_external"), F.col("shown").alias(f"{side}_shown"), display().alias(f"{side}_name"))


def _open(graph: CallGraph, ids: DataFrame | None, side: str) -> DataFrame:
    edges = graph.open_edges()
    return edges if ids is None else edges.join(ids.select(F.col("id").alias(side)).distinct(), side, "left_semi")


def callers(graph: CallGraph, ids: DataFrame | None, ref_ok: bool = False) -> DataFrame:
    """(src, dst, src_name, dst_name): visible callers of the given nodes (None: of all).

    References to an external node are never reported.
    """
    found = _open(graph, ids, "dst")
    if not ref_ok:
        found = found.where("is_call")
    found = found.join(_ends(graph, "src").where("src_shown"), "src").join(_ends(graph, "dst"), "dst")
    return found.where(graph.has_edge(ref_ok)).select("src", "dst", "src_name", "dst_name")


def callees(graph: CallGraph, ids: DataFrame | None, external_ok: bool = False, ref_ok: bool = False) -> DataFrame:
    """(src, dst, src_name, dst_name): visible callees of the given nodes (None: of all).

    With both flags, references to external nodes are reported.
    """
    found = _open(graph, ids, "src")
    if not ref_ok:
        found = found.where("is_call")
    far = _ends(graph, "dst").where("dst_shown")
    if not external_ok:
        far = far.where("not dst_external")
    return found.join(far, "dst").join(_ends(graph, "src").select("src", "src_name"), "src").select("src", "dst", "src_name", "dst_name")


def callers_report(graph: CallGraph, ids: DataFrame | None, ref_ok: bool = False) -> DataFrame:
    """(caller, callees): for each caller, the given nodes that it calls."""
    found = callers(graph, ids, ref_ok).groupBy("src", "src_name").agg(F.array_join(F.array_sort(F.collect_list("dst_name")), ", ").alias("callees"))
    return found.select(F.col("src_name").alias("caller"), "callees")


def callees_report(graph: CallGraph, ids: DataFrame | None, external_ok: bool = False, ref_ok: bool = False) -> DataFrame:
    """(callee, callers): for each callee, the given nodes that call it."""
    found = callees(graph, ids, external_ok, ref_ok).groupBy("dst", "dst_name").agg(F.array_join(F.array_sort(F.collect_list("src_name")), ", ").alias("callers"))
    return found.select(F.col("dst_name").alias("callee"), "callers")


def labels_report(graph: CallGraph, ids: DataFrame | None) -> DataFrame:
    """(name, labels): the sorted labels of the given nodes that have any."""
    own = graph.labels if ids is None else graph.labels.join(ids.select("id").distinct(), "id", "left_semi")
    found = own.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    return found.join(graph.nodes, "id").select(display().alias("name"), "labels")
