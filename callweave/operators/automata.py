"""Finite automata over selections of nodes: from patterns or by hand, determinised over classes of nodes, run over sequences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display
from ..graph import CallGraph
from ..plans.tables import written
from .select import ALL, Plan, Selection


class Pattern:
    """Combine selections with One, Seq, Alt, Star; ANY stands for any nodes, none included."""


@dataclass(frozen=True)
class One(Pattern):
    selection: Selection


@dataclass(frozen=True)
class Seq(Pattern):
    parts: tuple[Pattern, ...] = ()


@dataclass(frozen=True)
class Alt(Pattern):
    parts: tuple[Pattern, ...] = ()


@dataclass(frozen=True)
class Star(Pattern):
    part: Pattern


ANY = Star(One(ALL))


@dataclass(frozen=True)
class Automaton:
    """Moves (state, selection, next): in a state, a node of the selection leads to the next. Several moves may fit a node, all are followed.

    A sequence is accepted if some moves lead from a start state to a final one over all of it. States are any integers.
    """

    moves: tuple[tuple[int, Selection, int], ...]
    start: frozenset[int]
    final: frozenset[int]

    def __init__(self, moves: Iterable[tuple[int, Selection, int]], start: Iterable[int], final: Iterable[int]):
        for name, value in (("moves", tuple(moves)), ("start", frozenset(start)), ("final", frozenset(final))):
            object.__setattr__(self, name, value)


def automaton(pattern: Pattern | Automaton) -> Automaton:
    """The automaton of a pattern: a state before all nodes (0), and one for each place where it names a selection."""
    if isinstance(pattern, Automaton):
        return pattern
    selections: list[Selection] = []
    follow: dict[int, set[int]] = defaultdict(set)

    def chain(last: set[int], first: set[int]) -> None:
        for place in last:
            follow[place] |= first

    def read(p: Pattern) -> tuple[bool, set[int], set[int]]:
        """Whether p can be empty, and the places that can come first and last in it."""
        if isinstance(p, One):
            selections.append(p.selection)
            return False, {len(selections)}, {len(selections)}
        if isinstance(p, Star):
            _, first, last = read(p.part)
            chain(last, first)
            return True, first, last
        parts = [read(x) for x in p.parts]
        if isinstance(p, Alt):
            return any(e for e, _, _ in parts) or not parts, set().union(*(f for _, f, _ in parts)), set().union(*(x for _, _, x in parts))
        empty, first, last = True, set(), set()
        for e, f, to in parts:
            chain(last, f)
            first |= f if empty else set()
            last = to | (last if e else set())
            empty &= e
        return empty, first, last

    empty, first, last = read(pattern)
    chain({0}, first)
    moves = [(p, selections[q - 1], q) for p in sorted(follow) for q in sorted(follow[p])]
    return Automaton(moves, {0}, last | ({0} if empty else set()))


#: Classes of nodes, and moves of a determinised automaton, that the driver holds at most. Automata beyond keep their own states.
MOST_CLASSES = 4096
MOST_MOVES = 1 << 16


@dataclass
class Table:
    """An automaton over classes: moves (cls, state, next). If whole, it is deterministic, and lookup has the same as one array."""

    moves: DataFrame
    start: list[int]
    final: list[int]
    whole: bool
    lookup: list[int] | None = None
    classes: int = 0

    def ends(self, state: Column) -> Column:
        return state.isin(self.final) if self.final else F.lit(False)


def _determinised(own: Automaton, selections: list[Selection], masks: list[str]) -> Table | tuple[dict, list[int], list[int], int] | None:
    """The subset construction over the classes' masks, without states that lead to no end; None if it grows beyond MOST_MOVES."""
    place = {s: i for i, s in enumerate(selections)}
    by_state: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for state, selection, to in own.moves:
        by_state[state].append((place[selection], to))
    sets, todo, moves = {own.start: 0}, [own.start], {}
    for states in todo:  # grows while it is read
        for c, mask in enumerate(masks):
            to = frozenset(t for s in states for k, t in by_state[s] if mask[k] == "1")
            if to:
                if to not in sets:
                    sets[to] = len(sets)
                    todo.append(to)
                moves[sets[states], c] = sets[to]
                if len(moves) > MOST_MOVES or len(sets) * len(masks) > MOST_MOVES:
                    return None
    final = {i for states, i in sets.items() if states & own.final}
    back = defaultdict(set)
    for (s, _), t in moves.items():
        back[t].add(s)
    alive, todo = set(final), list(final)
    for t in todo:
        todo += back[t] - alive
        alive |= back[t]
    return {k: t for k, t in moves.items() if t in alive}, [0], sorted(final), len(sets)


def classified(own: Automaton, graph: CallGraph, symbols: DataFrame | None = None) -> tuple[DataFrame, Table]:
    """(the nodes with cls, the automaton's table over those classes). A class is what nodes have in common for all selections of the automaton.

    symbols (name): more nodes, unknown to the graph, whose display name that is. Nodes that no move takes have no class.
    """
    spark = graph.spark
    selections = list(dict.fromkeys(s for _, s, _ in own.moves))
    plan = Plan(graph, symbols)
    bits = [F.when(s.column(plan, False), F.lit("1")).otherwise(F.lit("0")) for s in selections]
    nodes = plan.nodes.withColumn("mask", F.concat(*bits) if bits else F.lit("")).where(F.col("mask").contains("1"))
    nodes = written(nodes.select("id", display().alias("name"), "external", "shown", "mask"), "classes")
    masks = [r[0] for r in nodes.select("mask").distinct().limit(MOST_CLASSES + 1).collect()]
    made = _determinised(own, selections, sorted(masks)) if len(masks) <= MOST_CLASSES else None
    if made is not None:
        moves, start, final, states = made
        masks = sorted(masks)
        rows = [(c, s, t) for (s, c), t in sorted(moves.items())]
        lookup = [-1] * (states * len(masks))
        for c, s, t in rows:
            lookup[s * len(masks) + c] = t
        known = spark.createDataFrame(list(enumerate(masks)), "cls int, mask string")
        return nodes.join(known, "mask").drop("mask"), Table(spark.createDataFrame(rows, "cls int, state int, next int"), start, final, True, lookup, len(masks))
    known = written(nodes.select("mask").distinct().select("mask", F.monotonically_increasing_id().alias("cls")), "class-ids")
    place = {s: i for i, s in enumerate(selections)}
    given = spark.createDataFrame([(place[s], p, q) for p, s, q in own.moves], "selection int, state int, next int")
    held = known.select("cls", F.posexplode(F.split("mask", "")).alias("selection", "bit")).where("bit = '1'")
    moves = written(held.join(given, "selection").select("cls", "state", "next").distinct(), "moves")
    return nodes.join(known, "mask").drop("mask"), Table(moves, sorted(own.start), sorted(own.final), False)


def matches(graph: CallGraph, sequences: DataFrame, column: str, pattern: Pattern | Automaton) -> DataFrame:
    """sequences with accepted: whether the automaton takes the whole array of names in a column.

    Names are display names of the graph's nodes, visible or not; others are nodes without labels or neighbours. An empty sequence is accepted if a start
    state is final; a null one gives null, one with a null name false. Distinct names are classified once; a sequence is then a fold over its
    array inside the row.
    """
    spark = graph.spark
    own = automaton(pattern)
    rows = written(sequences.withColumn("_n", F.monotonically_increasing_id()), "sequences")
    used = written(rows.select("_n", F.posexplode(column).alias("k", "name")), "symbols")
    symbols = used.select("name").where("name is not null").distinct()
    nodes, table = classified(own, graph, symbols)
    # Of nodes with one display name, the last one counts, as where names are resolved.
    of = nodes.groupBy("name").agg(F.max_by("cls", F.coalesce(F.col("id"), F.lit(-1))).alias("cls"))
    coded = used.join(of, "name", "left").groupBy("_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cls"))), lambda s: s["cls"]).alias("_classes"))
    if table.whole:
        to = F.split(F.lit(",".join(map(str, table.lookup))), ",").cast("array<int>") if table.lookup else F.array(F.lit(-1))
        step = lambda state, cls: F.when(cls.isNull() | (state < 0), -1).otherwise(F.coalesce(F.get(to, state * table.classes + cls), F.lit(-1)))
        ended = F.aggregate("_classes", F.lit(table.start[0]), step)
        accepted = table.ends(ended)
    else:
        moves = table.moves.groupBy("cls").agg(F.collect_list(F.struct("state", "next")).alias("moves"))
        held = used.join(of, "name", "left").join(moves, "cls", "left").groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("k", "moves"))).alias("_classes"))
        coded = held
        step = lambda states, m: F.array_distinct(F.transform(F.filter(F.coalesce(m["moves"], F.array().cast("array<struct<state:int,next:int>>")), lambda x: F.array_contains(states, x["state"])), lambda x: x["next"]))
        ended = F.aggregate("_classes", F.array(*map(F.lit, table.start)).cast("array<int>"), step)
        accepted = F.arrays_overlap(ended, F.array(*map(F.lit, table.final)).cast("array<int>"))
    found = rows.join(coded.select("_n", accepted.alias("accepted")), "_n", "left")
    empty = F.lit(bool(own.start & own.final))
    return found.select(*sequences.columns, F.when(F.col(column).isNull(), F.lit(None)).when(F.size(column) == 0, empty).otherwise(F.coalesce("accepted", F.lit(False))).alias("accepted"))
