"""Saved graphs: command scripts, DOT, and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display, kind, quoted
from ..graph import CallGraph
from ..operators.neighbours import callees
from ..plans.commits import commit, latest, unused


def _word(c: Column, bare: str = r"^[^\s\"#]+$") -> Column:
    """A word of a script: in quotes where its characters ask for them."""
    return F.when(c.rlike(bare), c).otherwise(quoted(F.regexp_replace(c, r'([\\"])', r"\\$1")))


def script_lines(graph: CallGraph) -> DataFrame:
    """(part, line): node lines of visible nodes, label lines of all labels, edge lines of visible defined callers."""
    nodes = graph.all_nodes(True).select(F.lit(0).alias("part"), F.when(F.col("external"), F.concat(F.lit("node --external "), _word(display()))).otherwise(F.concat_ws(" ", F.lit("node"), _word(display()), _word(F.col("file")))).alias("line"))
    label_word = r"^[\w.]+$"
    labels = graph.labels.join(graph.nodes, "id").select(F.lit(1).alias("part"), F.concat_ws(" ", F.lit("label"), _word(F.col("label")), _word(display(), label_word)).alias("line"))
    callers = graph.all_nodes(False).select("id")
    found = callees(graph, callers, True, True).join(graph.edges, ["src", "dst"])
    edges = found.select(F.lit(2).alias("part"), F.concat_ws(" ", F.lit("edge"), _word(F.col("src_name")), _word(F.col("dst_name")), kind()).alias("line"))
    return nodes.unionByName(labels).unionByName(edges)


def dot_edges(graph: CallGraph, external_ok: bool = False, ref_ok: bool = False) -> DataFrame:
    """(src_name, dst_name): edges of visible defined nodes."""
    return callees(graph, graph.all_nodes(False).select("id"), external_ok, ref_ok)


def dot_isolated(graph: CallGraph, external_ok: bool = False, ref_ok: bool = False) -> DataFrame:
    """(id, name): visible defined nodes that no such edge touches."""
    found = dot_edges(graph, external_ok, ref_ok)
    touched = found.select(F.col("src").alias("id")).unionByName(found.select(F.col("dst").alias("id")))
    return graph.all_nodes(False).join(touched.distinct(), "id", "left_anti").select("id", display().alias("name"))


def dot_clusters(graph: CallGraph) -> DataFrame:
    """(file, members): the nodes of each file, visible or not."""
    return graph.nodes.where("file is not null").groupBy("file").agg(F.array_sort(F.collect_list(display())).alias("members"))


def dot_lines(graph: CallGraph, external_ok: bool = False, ref_ok: bool = False, files: bool = False) -> DataFrame:
    """(part, line) of a DOT digraph, each edge, node or cluster a line."""
    def part(df: DataFrame, n: int, line: Column) -> DataFrame:
        return df.select(F.lit(n).alias("part"), line.alias("line"))

    spark = graph.spark
    out = part(spark.range(1), 0, F.lit("digraph callgraph {")).unionByName(part(spark.range(1), 4, F.lit("}")))
    if files:
        inner = F.concat(F.lit("subgraph "), quoted(F.concat(F.lit("cluster_"), "file")), F.lit(" { label = "), quoted(F.col("file")), F.lit("; "), F.array_join(F.transform("members", lambda m: F.concat(quoted(m), F.lit(";"))), " "), F.lit(" }"))
        out = out.unionByName(part(dot_clusters(graph), 1, inner))
    edges = dot_edges(graph, external_ok, ref_ok)
    out = out.unionByName(part(edges, 2, F.concat(quoted(F.col("src_name")), F.lit(" -> "), quoted(F.col("dst_name")), F.lit(";"))))
    return out.unionByName(part(dot_isolated(graph, external_ok, ref_ok), 3, F.concat(quoted(F.col("name")), F.lit(";"))))


def write_lines(parts: DataFrame, path: str) -> None:
    """Text files whose order is that of the parts: read by name, they are one script or digraph."""
    parts.repartitionByRange("part", "line").sortWithinPartitions("part", "line").select("line").write.text(path)


def save_script(graph: CallGraph, path: str) -> None:
    """What the view shows, for `read_script`; lines and pretty names aside from display names are lost."""
    write_lines(script_lines(graph), path)


def save_dot(graph: CallGraph, path: str, external_ok: bool = False, ref_ok: bool = False, files: bool = False) -> None:
    write_lines(dot_lines(graph, external_ok, ref_ok, files), path)


def save_tables(graph: CallGraph, path: str) -> None:
    """The whole graph without loss (the view apart). Its tables become visible together, once all are written; a writer that fails leaves the last graph."""
    spark = graph.spark
    number, _ = latest(spark, path)
    data = unused(path)
    for name in ("nodes", "edges", "labels"):
        getattr(graph, name).write.parquet(f"{data}/{name}")
    commit(spark, path, number + 1, {"data": data})
