"""Selections of nodes: names, patterns, labels, neighbours, and their combinations.

A selection compiles to one boolean column over nodes; names, labels and neighbours come in as left joins with
distinct ids, everything else is an expression that Catalyst sees through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display
from ..functions.regexes import java
from ..graph import CallGraph
from ..plans.tables import written
from .closure import all_callees, all_callers
from .neighbours import callees, callers


class Selection:
    """Combine with &, |, ~ and the methods callers(), callees(), all_callers(), all_callees()."""

    def __and__(self, other: Selection) -> Selection:
        return And((self, other))

    def __or__(self, other: Selection) -> Selection:
        return Or((self, other))

    def __invert__(self) -> Selection:
        return Not(self)

    def callers(self) -> Selection:
        return Step(self, "callers")

    def callees(self) -> Selection:
        return Step(self, "callees")

    def all_callers(self) -> Selection:
        return Step(self, "all_callers")

    def all_callees(self) -> Selection:
        return Step(self, "all_callees")

    def column(self, plan: Plan, among_visible: bool) -> Column:
        """Whether a node is selected. among_visible: patterns, negations and the empty conjunction range over visible nodes only."""
        raise NotImplementedError

    def ids(self, graph: CallGraph) -> DataFrame:
        """(id): the selected nodes."""
        return self.ids_in(Plan(graph))

    def ids_in(self, plan: Plan) -> DataFrame:
        wanted = self.column(plan, True)
        return plan.nodes.where(wanted).select("id")


class Plan:
    """The viewed nodes, with a flag for each joined set of ids. A selection that comes up again, also inside others, is worked out once.

    symbols (name): more rows, for names that the graph's nodes don't show; they have no id.
    """

    def __init__(self, graph: CallGraph, symbols: DataFrame | None = None, known: dict[Selection, DataFrame] | None = None):
        self.graph, self.nodes, self.flags = graph, graph.viewed(), 0
        self.own: dict[Selection, Column] = {}
        self.known = {} if known is None else known
        if symbols is not None:
            others = symbols.select("name").join(self.nodes.select(display().alias("name")), "name", "left_anti")
            self.nodes = self.nodes.unionByName(others.withColumns({"external": F.lit(True), "shown": F.lit(True)}), allowMissingColumns=True)

    def _flag(self, held: DataFrame, on: Column) -> Column:
        name = f"_in{self.flags}"
        self.flags += 1
        self.nodes = self.nodes.join(held.toDF(f"{name}_key").distinct().withColumn(name, F.lit(True)), on == F.col(f"{name}_key"), "left").drop(f"{name}_key")
        return F.coalesce(F.col(name), F.lit(False))

    def flag(self, selection: Selection, ids: Callable[[], DataFrame], on: Column | None = None) -> Column:
        """Whether a node is among the ids, or other keys `on`, of a selection, which are asked for once."""
        if selection not in self.own:
            self.own[selection] = self._flag(ids(), F.col("id") if on is None else on)
        return self.own[selection]

    def ids_of(self, selection: Selection, made: Callable[[], DataFrame]) -> DataFrame:
        """The written ids of a selection, the same wherever it stands."""
        if selection not in self.known:
            self.known[selection] = written(made().select("id").distinct(), "selected")
        return self.known[selection]


@dataclass(frozen=True)
class Name(Selection):
    """The node that a name stands for, visible or not."""

    name: str

    def column(self, plan: Plan, among_visible: bool) -> Column:
        found = plan.flag(self, lambda: plan.graph.resolve([self.name]).select("id"))
        return found | (F.col("id").isNull() & (display() == self.name))


@dataclass(frozen=True)
class Regex(Selection):
    """Nodes in whose display name the pattern is found."""

    pattern: str

    def __post_init__(self):
        java(self.pattern)

    def column(self, plan: Plan, among_visible: bool) -> Column:
        found = display().rlike(java(self.pattern))
        return found & F.col("shown") if among_visible else found


@dataclass(frozen=True)
class Label(Selection):
    """Nodes with a label, visible or not."""

    label: str

    def column(self, plan: Plan, among_visible: bool) -> Column:
        return plan.flag(self, lambda: plan.graph.labels.where(F.col("label") == self.label).select("id"))


@dataclass(frozen=True)
class And(Selection):
    """Nodes that all parts select; all nodes if there are none."""

    parts: tuple[Selection, ...] = ()

    def column(self, plan: Plan, among_visible: bool) -> Column:
        if not self.parts:
            return F.col("shown") if among_visible else F.lit(True)
        first, *rest = (p.column(plan, among_visible) for p in self.parts)
        for c in rest:
            first = first & c
        return first


@dataclass(frozen=True)
class Or(Selection):
    """Nodes that any part selects."""

    parts: tuple[Selection, ...] = ()

    def column(self, plan: Plan, among_visible: bool) -> Column:
        found = F.lit(False)
        for p in self.parts:
            found = found | p.column(plan, among_visible)
        return found


@dataclass(frozen=True)
class Not(Selection):
    part: Selection

    def column(self, plan: Plan, among_visible: bool) -> Column:
        found = ~self.part.column(plan, False)
        return found & F.col("shown") if among_visible else found


@dataclass(frozen=True)
class Step(Selection):
    """Neighbours of a selection: callers and callees over calls in the view (callees defined), or closures over everything."""

    part: Selection
    way: str

    def column(self, plan: Plan, among_visible: bool) -> Column:
        return plan.flag(self, lambda: plan.ids_of(self, lambda: self.found(plan)))

    def found(self, plan: Plan) -> DataFrame:
        graph = plan.graph
        start = self.part.ids_in(Plan(graph, known=plan.known))
        return {
            "callers": lambda: callers(graph, start).select(F.col("src").alias("id")),
            "callees": lambda: callees(graph, start).select(F.col("dst").alias("id")),
            "all_callers": lambda: all_callers(graph, start),
            "all_callees": lambda: all_callees(graph, start),
        }[self.way]()


@dataclass(frozen=True)
class Where(Selection):
    """Nodes for which a function of the display name's column holds; the hook for own predicates that Spark's functions can say."""

    test: object

    def column(self, plan: Plan, among_visible: bool) -> Column:
        found = self.test(display())
        return found & F.col("shown") if among_visible else found


@dataclass(frozen=True)
class Predicate(Selection):
    """Nodes whose display name a Python function takes. It is asked once for each distinct name, in Arrow batches."""

    test: Callable[[str], bool]

    def column(self, plan: Plan, among_visible: bool) -> Column:
        found = plan.flag(self, lambda: self.taken(plan.nodes.select(display().alias("name")).distinct()), display())
        return found & F.col("shown") if among_visible else found

    def taken(self, names: DataFrame) -> DataFrame:
        test = self.test

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [x for x in batch.column(0).to_pylist() if test(x)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["name"])

        return names.mapInArrow(run, "name string")


ALL = And()
