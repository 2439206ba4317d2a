"""The call graph as an immutable value over three DataFrames and a view."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import display

NODES = "id long, name string, username string, file string, line int, external boolean"
EDGES = "src long, dst long, is_call boolean"
LABELS = "id long, label string"
MARKS = "id long, keep boolean, omitted boolean, no_callers boolean, no_callees boolean"


@dataclass(frozen=True)
class CallGraph:
    """nodes (NODES), edges (EDGES, unique by ends), labels (LABELS, distinct).

    marks (MARKS) holds what commands have said of single nodes: keep and omitted decide on visibility,
    no_callers and no_callees hide all edges into or out of a node. default is the visibility of nodes without a
    mark. Without marks no join is planned for them. rejects (ord, file, line, reason), if any, is what its reader refused.
    """

    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame
    marks: DataFrame | None = None
    default: bool = True
    rejects: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def viewed(self) -> DataFrame:
        """nodes with shown: visible but for the question whether externals are wanted."""
        if self.marks is None:
            return self.nodes.withColumn("shown", F.lit(self.default))
        shown = F.when(F.col("keep"), True).when(F.col("omitted"), False).otherwise(F.lit(self.default))
        return self.nodes.join(self.marks.select("id", "keep", "omitted"), "id", "left").withColumn("shown", shown).drop("keep", "omitted")

    def all_nodes(self, external_ok: bool) -> DataFrame:
        """Visible nodes."""
        return self.viewed().where(F.col("shown") & (F.lit(True) if external_ok else ~F.col("external"))).drop("shown")

    def all_files(self) -> DataFrame:
        return self.nodes.where("file is not null").select("file").distinct()

    def nodes_for_file(self, file: str) -> DataFrame:
        """Nodes of a file, visible or not."""
        return self.nodes.where(F.col("file") == file)

    def node_count(self) -> int:
        return self.nodes.count()

    def aliases(self) -> DataFrame:
        """(alias, prio, id): pretty names (0) go before symbols (1)."""
        pretty = self.nodes.where("username is not null").select(F.col("username").alias("alias"), F.lit(0).alias("prio"), "id")
        return pretty.unionByName(self.nodes.select(F.col("name").alias("alias"), F.lit(1).alias("prio"), "id"))

    def resolve(self, names: list[str] | DataFrame) -> DataFrame:
        """(alias, id) of known names: a pretty name first (the last node that has it), else a symbol."""
        if isinstance(names, DataFrame):
            found = self.aliases().join(names.select("alias").distinct(), "alias", "left_semi")
        else:
            found = self.aliases().where(F.col("alias").isin(list(names)))
        return found.groupBy("alias").agg(F.max_by("id", F.struct(-F.col("prio"), "id")).alias("id"))

    def named(self, ids: DataFrame) -> DataFrame:
        """(id, name): the display names of ids."""
        return self.nodes.select("id", display().alias("name")).join(ids.select("id").distinct(), "id", "left_semi")

    def open_edges(self) -> DataFrame:
        """Edges that no command hides."""
        if self.marks is None:
            return self.edges
        no_out = self.marks.where("no_callees").select(F.col("id").alias("src"))
        no_in = self.marks.where("no_callers").select(F.col("id").alias("dst"))
        return self.edges.join(no_out, "src", "left_anti").join(no_in, "dst", "left_anti").select("src", "dst", "is_call")

    def has_edge(self, ref_ok: bool, is_call: Column | str = "is_call", dst_external: Column | str = "dst_external") -> Column:
        """The reference rule for a single edge: calls, and where wanted references, but never to an external node."""
        return F.col(is_call) | (F.lit(ref_ok) & ~F.col(dst_external))

    def edge_type(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, type) of pairs of ids; pairs without an edge count as ref."""
        known = pairs.join(self.edges, ["src", "dst"], "left")
        return known.select("src", "dst", F.when(F.col("is_call"), "call").otherwise("ref").alias("type"))

    def filter_edge(self, pairs: DataFrame, ref_ok: bool) -> DataFrame:
        """Those of pairs (src, dst) that are open edges under has_edge, whether their ends are visible or not."""
        dst = self.nodes.select(F.col("id").alias("dst"), F.col("external").alias("dst_external"))
        return self.open_edges().join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi").join(dst, "dst").where(self.has_edge(ref_ok)).select("src", "dst")

    def add_label(self, ids: DataFrame, label: str) -> CallGraph:
        return replace(self, labels=self.labels.unionByName(ids.select("id", F.lit(label).alias("label"))).distinct())

    def labeled_nodes(self, label: str) -> DataFrame:
        """(id, name) with the label, visible or not."""
        return self.named(self.labels.where(F.col("label") == label))

    def reset_labels(self) -> CallGraph:
        return replace(self, labels=self.labels.where("false"))

    def reset_filter(self) -> CallGraph:
        return replace(self, marks=None, default=True)
