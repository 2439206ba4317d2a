"""The graph's rules on small fixtures: definitions, edges, neighbours, views, selections, paths."""

import random

import pytest

from callweave.functions.columns import described, display
from callweave.graph import EDGES, LABELS, NODES, CallGraph
from callweave.operators import closure, neighbours, views
from callweave.operators.paths import Alt, Seq, paths
from callweave.operators.select import ALL, And, Label, Name, Or, Regex, Where
from callweave.operators.spec import SpecError, pattern, selection
from callweave.sources.facts import build, facts, rejected


def graph(spark, defined, edges, labels=(), external=()):
    rows = [{"kind": "node", "name": n} for n in defined] + [{"kind": "node", "name": n, "external": True} for n in external]
    rows += [{"kind": "edge", "name": a, "target": b, "is_call": k == "call"} for a, b, k in edges] + [{"kind": "label", "name": n, "label": k} for n, k in labels]
    return build(facts(spark, rows))


def names(df):
    return sorted(r["name"] for r in df.collect())


def shown(g, external=True):
    return names(g.all_nodes(external).select(display().alias("name")))


def picked(g, text):
    return names(g.named((selection(text) if isinstance(text, str) else text).ids(g)))


class Plain:
    """The same graph as sets, for answers by loops."""

    def __init__(self, defined, edges, labels=(), external=()):
        self.external = set(external)
        self.names = {*defined, *self.external}
        self.external |= {x for e in edges for x in e[:2]} - self.names
        self.names |= self.external
        self.calls = {(a, b) for a, b, k in edges if k == "call"}
        self.refs = {(a, b) for a, b, k in edges if k == "ref"} - self.calls
        self.labels = set(labels)

    def has(self, label):
        return {n for n, k in self.labels if k == label}

    def callees(self, of):
        return {b for a, b in self.calls if a in of and b not in self.external}

    def callers(self, of):
        return {a for a, b in self.calls if b in of}

    def reach(self, of, backwards=False):
        found, todo = set(), list(of)
        while todo:
            x = todo.pop()
            if x not in found:
                found.add(x)
                todo += [(a if backwards else b) for a, b in self.calls | self.refs if (b if backwards else a) == x]
        return found

    def paths(self, accept, external=True, ref=True):
        """All simple paths that accept takes, printed last to first."""
        steps, found = self.calls | (self.refs if ref else set()), []

        def grow(path):
            if accept(path):
                found.append(" ".join(reversed(path)))
            for a, b in sorted(steps):
                if a == path[-1] and b not in path and (external or b not in self.external):
                    grow([*path, b])

        for x in sorted(self.names):
            if external or x not in self.external:
                grow([x])
        return sorted(found)

    def omitted(self, target, callers):
        """What stays when the callers, or callees, of a node are left out: what has another edge, and what was no neighbour."""
        edges = self.calls | self.refs
        open_ = {e for e in edges if e[callers] != target}
        near = {target} | {e[not callers] for e in edges if e[callers] == target}
        gone = {x for x in near if not any(a == x for a, _ in open_) and not any(b == x and ((a, b) in self.calls or x not in self.external) for a, b in open_)}
        return sorted(self.names - gone)


#: A small logger: who calls whom, who is only passed on, and what is labelled.
LOGGER = Plain(
    ["start", "stop", "log_open", "log_write", "log_close", "format(char const*, int)", "retry", "timer_tick"],
    [
        ("start", "log_open", "call"), ("start", "timer_tick", "ref"), ("log_open", "retry", "call"), ("retry", "log_open", "call"), ("log_write", "format(char const*, int)", "call"),
        ("timer_tick", "log_write", "call"), ("log_write", "retry", "ref"), ("stop", "log_close", "call"), ("log_close", "log_write", "call"), ("log_write", "sys_write", "call"), ("retry", "sys_sleep", "ref"),
    ],
    [("log_open", "IO"), ("log_write", "IO"), ("sys_write", "IO"), ("log_write", "LOCKS"), ("log_close", "LOCKS"), ("start", "ENTRY"), ("stop", "ENTRY"), ("timer_tick", "ENTRY")],
)


@pytest.fixture(scope="module")
def logger(spark):
    edges = [(a, b, "call") for a, b in LOGGER.calls] + [(a, b, "ref") for a, b in LOGGER.refs]
    return graph(spark, sorted(LOGGER.names - LOGGER.external), sorted(edges), sorted(LOGGER.labels))


def test_definitions(spark):
    rows = [
        {"kind": "node", "name": "a", "external": True}, {"kind": "node", "name": "a", "username": "a()", "file": "f.c", "line": 456}, {"kind": "node", "name": "a", "file": "late.c"},
        {"kind": "edge", "name": "a()", "target": "x", "is_call": False}, {"kind": "edge", "name": "a", "target": "x", "is_call": True}, {"kind": "edge", "name": "a", "target": "x", "is_call": False},
        {"kind": "label", "name": "new", "label": "L"}, {"kind": "label", "name": "new", "label": "L"},
    ]
    g = build(facts(spark, rows))
    got = {r["name"]: r for r in g.nodes.collect()}
    assert set(got) == {"a", "x", "new"} and got["x"]["external"] and got["new"]["external"] and g.node_count() == 3
    assert (got["a"]["username"], got["a"]["file"], got["a"]["line"], got["a"]["external"]) == ("a()", "f.c", 456, False)
    assert [(r["src"], r["dst"], r["is_call"]) for r in g.edges.collect()] == [(got["a"]["id"], got["x"]["id"], True)]
    assert g.labels.count() == 1 and names(g.labeled_nodes("L")) == ["new"]
    assert {r["alias"]: r["id"] for r in g.resolve(["a", "a()", "none"]).collect()} == {"a": got["a"]["id"], "a()": got["a"]["id"]}
    assert sorted(r["t"] for r in g.nodes.select(described().alias("t")).collect()) == ["a() (f.c:456)", "new", "x"]
    assert build(facts(spark, [])).node_count() == 0


def test_rejected(spark):
    rows = [{"kind": "edge", "name": "a", "target": "b"}, {"kind": "node", "name": "a"}, {"kind": "edge", "name": "a", "target": "b"}, {"kind": "node", "name": "e", "external": True, "file": "f"}]
    assert sorted(r["ord"] for r in rejected(facts(spark, rows)).collect()) == [0, 3]


def test_references_to_externals(spark):
    g = graph(spark, "ab", [("a", "x", "ref"), ("a", "y", "call"), ("a", "b", "ref")])
    ids = ALL.ids(g)
    pairs = lambda df: sorted((r["src_name"], r["dst_name"]) for r in df.collect())
    assert pairs(neighbours.callers(g, ids, ref_ok=True)) == [("a", "b"), ("a", "y")]
    assert pairs(neighbours.callers(g, ids)) == [("a", "y")]
    assert pairs(neighbours.callees(g, ids)) == []
    assert pairs(neighbours.callees(g, ids, ref_ok=True)) == [("a", "b")]
    assert pairs(neighbours.callees(g, ids, external_ok=True)) == [("a", "y")]
    assert pairs(neighbours.callees(g, ids, True, True)) == [("a", "b"), ("a", "x"), ("a", "y")]
    by = {r["name"]: r["id"] for r in g.nodes.collect()}
    asked = spark.createDataFrame([(by["a"], by["x"]), (by["a"], by["b"]), (by["b"], by["a"])], "src long, dst long")
    assert [r["dst"] for r in g.filter_edge(asked, True).collect()] == [by["b"]] and g.filter_edge(asked, False).count() == 0
    assert {r["type"] for r in g.edge_type(asked).collect()} == {"ref"}


IO, LOCKS, ENTRY, EVERY = LOGGER.has("IO"), LOGGER.has("LOCKS"), LOGGER.has("ENTRY"), LOGGER.names


@pytest.mark.parametrize("text,want", [
    ("retry", {"retry"}), ("nowhere", set()), ("[]", EVERY), ("![]", set()), ("[!]", set()), ("[IO]", IO), ("[IO,LOCKS]", IO & LOCKS), ("[ IO | LOCKS ]", IO | LOCKS), ("![IO|LOCKS]", EVERY - IO - LOCKS),
    ("[!IO,!LOCKS]", EVERY - IO - LOCKS), ("![!IO]", IO), ("/^log_/", {n for n in EVERY if n.startswith("log_")}), ('[/t/,!"start"]', {n for n in EVERY if "t" in n} - {"start"}),
    ('"format(char const*, int)"', {"format(char const*, int)"}), ("start  stop", {"start", "stop"}), ("retry:callers", LOGGER.callers({"retry"})), ('["log_write":callers]', LOGGER.callers({"log_write"})),
    ('["log_write"]:callees', LOGGER.callees({"log_write"})), ("[ENTRY:callees]", LOGGER.callees(ENTRY)), ("[!ENTRY:callees]", LOGGER.callees(EVERY - ENTRY)),
    ("[IO,ENTRY:callees,![LOCKS:callees]]", IO & LOGGER.callees(ENTRY) - LOGGER.callees(LOCKS)), ("retry:callers:callees", LOGGER.callees(LOGGER.callers({"retry"}))),
    ("retry:all_callers", LOGGER.reach({"retry"}, True)), ("timer_tick:all_callees", LOGGER.reach({"timer_tick"})),
])
def test_selections(logger, text, want):
    assert picked(logger, text) == sorted(want)


def test_composed(logger):
    assert picked(logger, (Label("IO") | Name("stop")) & ~Regex("write$")) == ["log_open", "stop"]
    assert picked(logger, Where(lambda c: c.contains("tick"))) == ["timer_tick"]
    assert picked(logger, And()) == picked(logger, "[]") and picked(logger, Or()) == []


@pytest.mark.parametrize("text", ["", "!!a", "[a", "a]", "/(/", '"open', "a ,b", "a*"])
def test_invalid(text):
    with pytest.raises(SpecError):
        selection(text)


@pytest.mark.parametrize("text", ["", "a |", "(a", "a **", "a *", "*"])
def test_invalid_paths(text):
    with pytest.raises(SpecError):
        pattern(text)


def walked(g, text, external=True, ref=True, **more):
    return sorted(" ".join(reversed(r["path"])) for r in paths(g, pattern(text) if isinstance(text, str) else text, external, ref, **more).collect())


def inside(path, kept):
    return all(x in kept for x in path)


@pytest.mark.parametrize("text,flags,accept", [
    ("retry", {}, lambda p: p == ["retry"]), ("log_write retry", {}, lambda p: p == ["log_write", "retry"]), ("start ... log_write", {}, lambda p: p[0] == "start" and p[-1] == "log_write"),
    ("[IO]", {}, lambda p: len(p) == 1 and p[0] in IO), ("[ENTRY] ... [IO] ... sys_write", {}, lambda p: len(p) > 1 and p[0] in ENTRY and p[-1] == "sys_write" and bool(IO & set(p[1:-1]))),
    ("[ENTRY] [!LOCKS]* retry", {}, lambda p: len(p) > 1 and p[0] in ENTRY and p[-1] == "retry" and inside(p[1:-1], EVERY - LOCKS)), ("[LOCKS] [!LOCKS]", {"ref": False}, lambda p: len(p) == 2 and p[0] in LOCKS and p[1] not in LOCKS),
    ("[LOCKS] [!LOCKS]", {"external": False}, lambda p: len(p) == 2 and p[0] in LOCKS and p[1] not in LOCKS), ("(start | timer_tick)* log_write", {}, lambda p: p[-1] == "log_write" and inside(p[:-1], {"start", "timer_tick"})), ("... sys_sleep", {}, lambda p: p[-1] == "sys_sleep"),
])
def test_paths(logger, text, flags, accept):
    want = LOGGER.paths(accept, **flags)
    assert want and walked(logger, text, **flags) == want


def test_paths_in_views(logger):
    cut = LOGGER.paths(lambda p: p[0] == "start" and p[-1] == "sys_sleep" and "retry" not in p[1:-1] or p == ["start"])
    assert walked(logger, "start ... sys_sleep", limit=0) == [] and len(walked(logger, "start ... sys_sleep", limit=1)) == 1 and cut == ["start"]
    assert walked(views.omit(logger, Name("retry").ids(logger)), "start ... sys_sleep") == []
    assert walked(views.omit_callees_of(logger, Name("retry").ids(logger)), "start ... sys_sleep") == []
    one = views.only(logger, Name("stop").ids(logger))
    assert walked(one, "[ENTRY]") == ["stop"] and walked(views.keep(one, Name("start").ids(one)), "[ENTRY]") == ["start", "stop"]
    with pytest.raises(ValueError):
        walked(logger, "start ... sys_sleep", most_nodes=2)
    assert walked(logger, Seq()) == [] and walked(logger, Alt()) == []


@pytest.mark.parametrize("target", ["log_write", "retry", "stop", "sys_write", "format(char const*, int)"])
def test_omitted_neighbours(logger, target):
    assert shown(views.omit_callers_of(logger, Name(target).ids(logger))) == LOGGER.omitted(target, True)
    assert shown(views.omit_callees_of(logger, Name(target).ids(logger))) == LOGGER.omitted(target, False)
    left = neighbours.callers(views.omit_callers_of(logger, Name(target).ids(logger)), None).collect()
    assert left and not any(r["dst_name"] == target for r in left)


def test_last_command_wins(spark):
    g = graph(spark, ["a", "b", "c"], [("a", "b", "call"), ("b", "c", "call")])
    b = Name("b").ids(g)
    hidden = views.omit(g, b)
    assert shown(hidden) == ["a", "c"] and shown(views.keep(hidden, b)) == ["a", "b", "c"] and shown(views.omit(views.keep(hidden, b), b)) == ["a", "c"]
    assert picked(hidden, "/b/") == [] and picked(hidden, "b") == ["b"]
    assert shown(hidden.reset_filter()) == ["a", "b", "c"]
    assert shown(views.only(views.only(g, b), Name("c").ids(g))) == ["b", "c"]
    assert shown(views.only(g, b, callers=True)) == ["a", "b"] and shown(views.only(g, b, callees=True)) == ["b", "c"]
    both = hidden.filter_edge(g.edges, True)
    assert both.count() == 2  # visibility of the ends doesn't matter here


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    n = 9
    all_names = [f"n{i}" for i in range(n)]
    external = set(rng.sample(all_names, 2))
    edges = [(a, b, rng.choice(["call", "call", "ref"])) for a in all_names if a not in external for b in rng.sample(all_names, 2)]
    labels = [(x, k) for x in all_names for k in "XY" if rng.random() < 0.4]
    g = graph(spark, [x for x in all_names if x not in external], edges, labels, sorted(external))
    own = Plain([x for x in all_names if x not in external], edges, labels, external)
    x, y = own.has("X"), own.has("Y")
    assert picked(g, "[X]:all_callees") == sorted(own.reach(x))
    assert names(g.named(closure.all_callees(g, Label("X").ids(g)))) == sorted(own.reach(x))
    assert names(g.named(closure.all_callers(g, Label("X").ids(g)))) == sorted(own.reach(x, True))

    def accept(path):
        return len(path) > 1 and path[0] in x and (path[-1] in y or len(path) > 2 and path[-2] in y and path[-1] not in y)

    for ref in (False, True):
        for ext in (False, True):
            assert walked(g, "[X] []* [Y] | [X] []* [Y] [!Y]", ext, ref) == own.paths(accept, ext, ref)

    target = rng.choice(all_names)
    assert shown(views.omit_callers_of(g, Name(target).ids(g))) == own.omitted(target, True)
    assert shown(views.omit_callees_of(g, Name(target).ids(g))) == own.omitted(target, False)


def test_schemas(logger):
    for df, schema in ((logger.nodes, NODES), (logger.edges, EDGES), (logger.labels, LABELS)):
        assert [f"{n} {t}".replace("bigint", "long") for n, t in df.dtypes] == schema.split(", ")
    more = logger.add_label(Name("retry").ids(logger), "SLOW")
    assert isinstance(more, CallGraph) and picked(more, "[SLOW]") == ["retry"] and picked(logger.reset_labels(), "[IO]") == []
