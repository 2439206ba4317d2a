"""Facts at their own place, against a graph that takes them one by one; graphs that grow; what readers refuse."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from callweave.functions.columns import display
from callweave.operators.ordered import Events, as_of, carried, numbered
from callweave.plans import commits
from callweave.sinks import writers
from callweave.sources import readers
from callweave.sources.facts import FACTS, build, facts, history
from callweave.sources.readers import Source
from callweave.sources.store import Store, load_into


class OneByOne:
    """Facts in their order, each on what is there by then."""

    def __init__(self):
        self.nodes, self.by_name, self.by_pretty, self.edges, self.labels, self.refused = [], {}, {}, {}, set(), []

    def find(self, name):
        return self.by_pretty.get(name, self.by_name.get(name))

    def get(self, name):
        i = self.find(name)
        if i is None:
            i = self.by_name[name] = len(self.nodes)
            self.nodes.append([i, name, None, None, None, True])
        return i

    def take(self, rows):
        for k, r in enumerate(rows):
            if r["kind"] == "node":
                i = self.get(r["name"])
                if not r.get("external") and self.nodes[i][5]:
                    self.nodes[i][2:] = [r.get("username"), r.get("file"), r.get("line"), False]
                    if r.get("username"):
                        self.by_pretty[r["username"]] = i
            elif r["kind"] == "edge":
                i = self.find(r["name"])
                if r.get("checked") and (i is None or self.nodes[i][5]):
                    self.refused.append((k, "caller not found in graph" if i is None else "cannot add edge from external node"))
                    continue
                ends = self.get(r["name"]), self.get(r["target"])
                self.edges[ends] = self.edges.get(ends, False) or r.get("is_call", True)
            elif not r.get("checked") or self.find(r["name"]) is not None:
                self.labels.add((self.get(r["name"]), r["label"]))
        return self

    def tables(self):
        return sorted(map(tuple, self.nodes)), sorted((*e, c) for e, c in self.edges.items()), sorted(self.labels)


def tables(g):
    return tuple(sorted(map(tuple, df.collect())) for df in (g.nodes.select("id", "name", "username", "file", "line", "external"), g.edges.select("src", "dst", "is_call"), g.labels.select("id", "label")))


def random_facts(seed, n):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "p()", "q()", "r"]
    rows = []
    for _ in range(n):
        kind = rng.choice(["node", "node", "edge", "edge", "edge", "label"])
        r = {"kind": kind, "name": rng.choice(names)}
        if kind == "node":
            r |= {"external": True} if rng.random() < 0.3 else {"username": rng.choice([None, "p()", "q()", "a"]), "file": rng.choice([None, "f.c"]), "line": rng.choice([None, 7])}
        elif kind == "edge":
            r |= {"target": rng.choice(names), "is_call": rng.random() < 0.5, "checked": rng.random() < 0.6}
        else:
            r |= {"label": rng.choice("XY"), "checked": rng.random() < 0.6}
        rows.append(r)
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_facts_at_their_place(spark, seed):
    rows = random_facts(seed, 24)
    want = OneByOne().take(rows)
    found = history(facts(spark, rows))
    assert tables(found.at()) == want.tables()
    assert sorted((r["ord"], r["reason"].partition(":")[0]) for r in found.rejects.collect()) == want.refused
    half = OneByOne().take(rows[:12])
    # What an earlier snapshot shows is what was there by then; pretty names that came later aren't known to it.
    assert tables(found.at(12)) == half.tables()


def sources(spark, rows):
    return Source(facts(spark, rows), spark.createDataFrame([], "ord long, file string, line long, reason string"))


@pytest.mark.parametrize("seed", [11, 12])
def test_growing(spark, tmp_path, seed):
    rows = random_facts(seed, 30)
    store = Store(spark, str(tmp_path / "g"), buckets=5)
    ids = {}
    for a, b in ((0, 9), (9, 10), (10, 10), (10, 30)):
        store.load(sources(spark, rows[a:b]))
        g = store.graph()
        now = dict(g.nodes.select("name", "id").collect())
        assert ids.items() <= now.items()  # an id never changes
        ids = now
        assert tables(g) == OneByOne().take(rows[:b]).tables()
    assert tables(Store(spark, str(tmp_path / "g")).graph()) == tables(build(facts(spark, rows)))
    assert sorted(r["ord"] for r in store.rejects().collect()) == [k for k, _ in OneByOne().take(rows).refused]


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "bucket=" in d}


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"), buckets=16)
    store.load(sources(spark, [{"kind": "node", "name": f"n{i}"} for i in range(60)] + [{"kind": "edge", "name": f"n{i}", "target": f"n{i + 1}"} for i in range(50)]))
    before, at = files_of(tmp_path / "g"), json.loads(json.dumps(store.manifest["tables"]))
    store.load(sources(spark, [{"kind": "edge", "name": "n3", "target": "fresh", "is_call": False}]))
    now = store.manifest["tables"]
    moved = {t: [b for b in now[t] if now[t][b] != at[t].get(b)] for t in now}
    assert {t: len(b) for t, b in moved.items()} == {"nodes": 1, "edges": 1, "labels": 0, "aliases": 0}
    assert before <= files_of(tmp_path / "g") and len({os.path.dirname(f) for f in files_of(tmp_path / "g") - before}) == 2
    assert store.graph().node_count() == 61 and store.graph().edges.count() == 51


def test_a_load_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "g"), buckets=4).load(sources(spark, [{"kind": "edge", "name": "a", "target": "b"}]))
    before = tables(store.graph())
    plain = Store._write

    def breaks(self, name, *more):
        if name == "labels":
            raise OSError("lost")
        return plain(self, name, *more)

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Store, "_write", breaks)
        store.load(sources(spark, [{"kind": "node", "name": "late"}, {"kind": "label", "name": "late", "label": "L"}]))
    assert tables(store.graph()) == before == tables(Store(spark, str(tmp_path / "g")).graph())
    other = Store(spark, str(tmp_path / "g"))
    store.load(sources(spark, [{"kind": "node", "name": "mine"}]))
    with pytest.raises(Exception, match="(?i)exist"):
        other.load(sources(spark, [{"kind": "node", "name": "theirs"}]))  # two writers: the second starts again from what is there
    assert sorted(dict(Store(spark, str(tmp_path / "g")).graph().nodes.select("name", "id").collect())) == ["a", "b", "mine"]
    store.load(sources(spark, [{"kind": "node", "name": "once"}]), ("s", 3))
    number = store.version
    assert store.load(sources(spark, [{"kind": "node", "name": "again"}]), ("s", 3)).version == number


def test_saved_tables_appear_together(spark, tmp_path, monkeypatch):
    one, two = (build(facts(spark, [{"kind": "edge", "name": n, "target": "b"}])) for n in ("a", "c"))
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        readers.read_tables(spark, path)
    writers.save_tables(one, path)
    with pytest.raises(AttributeError):
        writers.save_tables(type("Broken", (), {"spark": spark, "nodes": two.nodes})(), path)  # killed after the first table
    assert tables(readers.read_tables(spark, path)) == tables(one)
    writers.save_tables(two, path)
    assert tables(readers.read_tables(spark, path)) == tables(two) and commits.latest(spark, path)[0] == 2


DUMP = ";; Function head (head, funcdef_no=0)\n" + "".join(f'(call_insn {i} (call (mem (symbol_ref:DI ("callee{i % 40}") [flags]))\n(insn {i} no symbol here at all)\n' for i in range(400)) + ";; Function int tail(int) (_Z4taili, funcdef_no=1) (executed once)\n" + '(insn (symbol_ref:DI ("head") [flags]))\n' * 3


def test_dumps_in_splits(spark, tmp_path):
    (tmp_path / "big.c.229r.expand").write_text(DUMP)
    (tmp_path / "next.c.229r.expand").write_text(';; Function next\n(insn (symbol_ref:DI ("int tail(int)") [flags]))\n')
    whole = tables(readers.load(spark, "rtl", str(tmp_path)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        text = readers.lines(spark, str(tmp_path))
        assert text.select("file", "start").distinct().count() > 10
        split = readers.load(spark, "rtl", str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    names = dict(split.nodes.select("id", "name").collect())
    assert tables(split) == whole and {r["username"] for r in split.nodes.collect()} == {None, "head", "int tail(int)"}
    assert {(names[r["src"]], names[r["dst"]]) for r in split.edges.collect()} == {*(("head", f"callee{i}") for i in range(40)), ("_Z4taili", "head"), ("next", "_Z4taili")}


def test_refused_lines(spark, tmp_path):
    def read(text):
        (tmp_path / "s.txt").write_text(text)
        g = readers.read_script(spark, str(tmp_path / "s.txt"))
        return sorted((r["line"], r["reason"].partition(":")[0]) for r in g.rejects.collect() if r["line"]), g

    wrong = ["edge a b bogus", "edge a", "node --wrong a", "node c f.c more", "node", "node --external d f.c", "omit", "omit [a", "label", "paint a"]
    found, g = read("node a f.c\n\n# note\n" + "\n".join(wrong) + "\nedge a e\nlabel L ghost a\n")
    why = ["not a command of a graph"] * 5 + ["file not allowed for external symbols", "not a command of a graph", "invalid search terms at '[a'", "not a command of a graph", "not a command of a graph"]
    assert [k for k, _ in found] == list(range(4, 14)) and [r.split(" at")[0] for _, r in found] == [r.split(" at")[0] for r in why]
    assert sorted(n for n, in g.nodes.select("name").collect()) == ["a", "e"] and [r["name"] for r in g.labeled_nodes("L").collect()] == ["a"]
    found, g = read("edge late a\nnode late\nnode --external x\nedge x late\nedge late a\n")
    assert len(g.rejects.collect()) == 2 and g.edges.count() == 1
    assert sorted((r["ord"], r["reason"]) for r in g.rejects.collect()) == [(0, "caller not found in graph: late"), (3, "cannot add edge from external node: x")]


def test_commands_at_their_place(spark, tmp_path):
    def shown(text):
        (tmp_path / "s.txt").write_text(text)
        g = readers.read_script(spark, str(tmp_path / "s.txt"), strict=True)
        labels = sorted((r["label"], g.nodes.where(F.col("id") == r["id"]).first()["name"]) for r in g.labels.collect())
        return sorted(r["n"] for r in g.all_nodes(True).select(display().alias("n")).collect()), labels

    assert shown("node a\nomit b\nnode b\n") == (["a", "b"], [])
    assert shown("node a\nnode b\nomit b\nnode c\n") == (["a", "c"], [])
    assert shown("node a\nonly /./\nnode b\n") == (["a"], [])
    assert shown("node a\nnode b\nedge a b\nomit --callers b\nnode c\nedge c b\n") == (["c"], [])
    assert shown("node a\nlabel L /./\nnode b\nlabel M [!L]\nreset --labels\nlabel N [L] b\nlabel O a\n") == (["a", "b"], [("N", "b"), ("O", "a")])


def test_commands_in_a_growing_graph(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"), buckets=4)
    for k, text in enumerate(("node a f.c\nnode b\nlabel L a\nomit b\n", "node c\nedge a b\nlabel L [!L]\n", "bogus\nreset --labels\nlabel M /c/\n")):
        (tmp_path / f"{k}.txt").write_text(text)
        load_into(store, "script", str(tmp_path / f"{k}.txt"))
        g = Store(spark, str(tmp_path / "g")).graph()
        assert sorted(r["name"] for r in g.all_nodes(True).collect()) == ["a", "c"][: 1 + (k > 0)]
        names = dict(g.nodes.select("id", "name").collect())
        assert sorted((r["label"], names[r["id"]]) for r in g.labels.collect()) == [[("L", "a")], [("L", "a"), ("L", "c")], [("M", "c")]][k]
    assert [(r["line"], r["reason"]) for r in g.rejects.collect()] == [(1, "not a command of a graph: bogus")]
    with pytest.raises(ValueError):
        load_into(store, "none", "x")


def test_dumps_scripts_and_facts_in_turn(spark, tmp_path):
    """Loads one after another are the same as one batch of all their facts."""
    (tmp_path / "x.c.1r.expand").write_text(';; Function void run() (_Z3runv, n=1)\n(call (symbol_ref:DI ("helper") [f]))\n')
    (tmp_path / "s.txt").write_text('node helper h.c\nedge helper "void run()" ref\nedge nobody helper\n')
    store = Store(spark, str(tmp_path / "g"), buckets=3)
    load_into(store, "rtl", str(tmp_path / "x.c.1r.expand"))
    load_into(store, "script", str(tmp_path / "s.txt"))
    store.load(sources(spark, [{"kind": "edge", "name": "helper", "target": "_Z3runv"}, {"kind": "label", "name": "new", "label": "L"}]))
    rows = [
        {"kind": "node", "name": "_Z3runv", "username": "void run()", "file": "x.c.o"}, {"kind": "edge", "name": "_Z3runv", "target": "helper"}, {"kind": "node", "name": "helper", "file": "h.c"},
        {"kind": "edge", "name": "helper", "target": "void run()", "is_call": False}, {"kind": "edge", "name": "nobody", "target": "helper", "checked": True}, {"kind": "edge", "name": "helper", "target": "_Z3runv"},
        {"kind": "label", "name": "new", "label": "L"},
    ]
    assert tables(store.graph()) == OneByOne().take(rows).tables() == tables(build(facts(spark, rows)))


def test_files_that_cannot_be_read(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"m{i}.c.229r.expand").write_text(f";; Function f{i}\n")
    (tmp_path / "notes.md").write_text(";; Function lost\n")
    g = readers.load(spark, "rtl", [str(tmp_path), str(tmp_path / "none.c.1r.expand")])
    assert sorted(n for n, in g.nodes.select("name").collect()) == [f"f{i}" for i in range(9)]
    assert sorted((os.path.basename(r["file"]), r["reason"]) for r in g.rejects.collect()) == [("none.c.1r.expand", "no such file"), ("notes.md", "not the name of a dump")]


def test_object_files(spark, tmp_path):
    entry = {"directory": str(tmp_path), "command": "cc -c x.c", "file": "x.c"}
    (tmp_path / "db.json").write_text(json.dumps([entry | {"output": f"{n}.o"} for n in ("x", "two", "bare")]))
    for name in ("x.o.229r.expand", "two.o.1r.expand", "two.o.2r.expand", "other.o.1r.expand"):
        (tmp_path / name).write_text(f";; Function {name[0]}\n")
    asked = [str(tmp_path / f"{n}.o") for n in ("x", "two", "bare", "other")]
    g = readers.load(spark, "rtl", asked, compdb=str(tmp_path / "db.json"))
    assert [tuple(r) for r in g.nodes.select("name", "file").collect()] == [("x", "x.o.o")]
    why = {os.path.basename(r["file"]): r["reason"] for r in g.rejects.collect()}
    assert set(why) == {"two.o", "bare.o", "other.o"} and "more than one" in why["two.o"] and "no dump" in why["bare.o"] and "compile database" in why["other.o"]
    assert readers.load(spark, "rtl", asked[:1]).rejects.count() == 1  # no database knows it


def test_ordered(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), i, rng.choice([None, None, f"v{i}"])) for i in range(300)]
    found = numbered(spark.createDataFrame(rows, "k string, ord long, v string").repartition(7), ["ord"], "place", 5)
    assert sorted((r["ord"], r["place"]) for r in found.collect()) == [(i, i + 5) for i in range(300)]
    last, want = {}, []
    for k, i, v in rows:
        last[k] = v or last.get(k)
        want.append((k, i, last[k]))
    cut = spark.createDataFrame(rows, "k string, ord long, v string").withColumn("part", F.expr("ord div 17"))
    assert sorted((r["k"], r["ord"], r["v"]) for r in carried(cut, "k", "part", ["ord"], "v").collect()) == sorted(want)
    events = [(k, i, f"s{i}") for k, i, v in rows if v] + [("one", 50, "only")]
    asked = [(rng.choice(["a", "b", "c", "one", "none"]), rng.randrange(300)) for _ in range(200)]
    told = as_of(spark.createDataFrame(asked, "k string, ord long"), Events(spark.createDataFrame(events, "alias string, ord long, symbol string")), "k", "found")
    want = [(k, o, max(((i, s) for a, i, s in events if a == k and i < o), default=(0, None))[1]) for k, o in asked]
    assert sorted(map(tuple, told.collect()), key=repr) == sorted(want, key=repr)
    assert FACTS.split(", ")[0] == "ord long"
