"""Readers and writers: dumps, scripts, compile databases, DOT, tables, streams."""

import json

import pytest
from pyspark.sql import functions as F

from callweave.functions.columns import display
from callweave.operators import neighbours, views
from callweave.operators.select import Name
from callweave.sinks import writers
from callweave.sources import readers
from callweave.sources.facts import build, facts
from callweave.streaming import incremental

DUMP = """;; Function main (main, funcdef_no=0, decl_uid=1)
(call_insn 5 (call (mem:QI (symbol_ref:DI ("helper") [flags 0x3]) (symbol_ref:DI ("second"))
(insn 6 (set (reg) (symbol_ref:DI ("callback") [flags 0x3])
;; Function int f(int, float) (_Z1fif, funcdef_no=1)
;; Function plain
(call_insn 7 (call (mem:QI (symbol_ref:DI ("int f(int, float)")
"""


def edges(g):
    name = g.nodes.select(F.col("id").alias("src"), "name").withColumnRenamed("name", "a")
    found = g.edges.join(name, "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return sorted((r["a"], r["b"], r["is_call"]) for r in found.collect())


def test_dump(spark, tmp_path):
    (tmp_path / "x.c.229r.expand").write_text(DUMP)
    (tmp_path / "foo.o.229r.expand").write_text("(symbol_ref (\"lost\")\n;; Function foo\n(insn (symbol_ref:DI (\"main\")\n")
    g = readers.load(spark, "rtl", str(tmp_path))
    got = {r["name"]: (r["username"], r["file"], r["external"]) for r in g.nodes.collect()}
    assert got == {
        "main": ("main", "x.c.o", False), "_Z1fif": ("int f(int, float)", "x.c.o", False), "plain": (None, "x.c.o", False), "foo": (None, "foo.o.o", False),
        "helper": (None, None, True), "callback": (None, None, True),
    }
    assert edges(g) == [("foo", "main", False), ("main", "callback", False), ("main", "helper", True), ("plain", "_Z1fif", True)]
    with pytest.raises(ValueError):
        readers.load(spark, "none", "x")


SCRIPT = """# a comment
node scan a.c
 node emit_row   a.c
node --external ext
node "Grid::draw" a.c
node "with space"

label paint emit_row "Grid::draw"
edge "Grid::draw" scan call
edge emit_row ext ref
edge emit_row new
unknown line
"""


def test_script(spark, tmp_path):
    (tmp_path / "in.txt").write_text(SCRIPT)
    g = readers.load(spark, "script", str(tmp_path / "in.txt"))
    assert {r["name"]: r["external"] for r in g.nodes.collect()} == {"scan": False, "emit_row": False, "ext": True, "Grid::draw": False, "with space": False, "new": True}
    assert edges(g) == [("Grid::draw", "scan", True), ("emit_row", "ext", False), ("emit_row", "new", True)]
    writers.save_script(g, str(tmp_path / "out"))
    again = readers.load(spark, "script", str(tmp_path / "out"))
    assert edges(again) == edges(g) and sorted(map(tuple, again.nodes.drop("id").collect()), key=repr) == sorted(map(tuple, g.nodes.drop("id").collect()), key=repr)
    assert {r["name"] for r in again.labeled_nodes("paint").collect()} == {"emit_row", "Grid::draw"}
    writers.save_tables(g, str(tmp_path / "tables"))
    whole = readers.load(spark, "tables", str(tmp_path / "tables"))
    assert sorted(map(tuple, whole.nodes.collect()), key=repr) == sorted(map(tuple, g.nodes.collect()), key=repr) and edges(whole) == edges(g)
    hidden = views.omit(g, Name("scan").ids(g))
    text = [r["line"] for r in writers.script_lines(hidden).collect()]
    assert not any("scan" in x for x in text)


def test_dot(spark, tmp_path):
    rows = [{"kind": "node", "name": n, "file": f} for n, f in (("a", "f.c"), ("b", "f.c"), ("alone", None))] + [{"kind": "edge", "name": "a", "target": t, "is_call": c} for t, c in (("b", True), ("x", True), ("y", False))]
    g = build(facts(spark, rows))
    writers.save_dot(g, str(tmp_path / "dot"), files=True)
    text = [r["value"] for r in sorted(spark.read.text(str(tmp_path / "dot")).withColumn("f", F.input_file_name()).collect(), key=lambda r: r["f"])]
    assert set(text) == {"digraph callgraph {", 'subgraph "cluster_f.c" { label = "f.c"; "a"; "b"; }', '"a" -> "b";', '"alone";', "}"}
    assert {r["dst_name"] for r in writers.dot_edges(g, True, True).collect()} == {"b", "x", "y"}
    assert [r["name"] for r in writers.dot_isolated(g).collect()] == ["alone"]


def test_report_of_script(spark, tmp_path):
    lines = ["node reader in.c", "node writer out.c", 'node "Pipe::pump" pipe.c', 'node "Pipe::~Pipe" pipe.c', 'edge "Pipe::pump" reader call', 'edge "Pipe::pump" writer call', 'edge "Pipe::~Pipe" "Pipe::pump" call', "edge writer writer call", "edge reader writer ref"]
    (tmp_path / "g.txt").write_text("\n".join(lines))
    g = readers.read_script(spark, str(tmp_path / "g.txt"))
    got = {r["caller"]: r["callees"] for r in neighbours.callers_report(g, None).collect()}
    assert got == {"Pipe::pump": "reader, writer", "Pipe::~Pipe": "Pipe::pump", "writer": "writer"}


def test_script_commands(spark, tmp_path):
    def read(text, strict=False):
        (tmp_path / "c.txt").write_text(text)
        return readers.read_script(spark, str(tmp_path / "c.txt"), strict)

    facts = "node boot main.c\nnode tick timer.c\nnode idle\nedge boot tick\nedge tick idle ref\nlabel hot tick idle\n# omit boot\n"
    g = read(facts + 'label warm [hot, !"idle"]\nomit boot\n')
    names = dict(g.nodes.select("id", "name").collect())
    assert {names[r["id"]] for r in g.labeled_nodes("warm").select("id").collect()} == {"tick"}
    assert {names[r["id"]] for r in g.labeled_nodes("hot").select("id").collect()} == {"tick", "idle"}
    by_hand = views.omit(build(readers.script_facts(readers.lines(spark, str(tmp_path / "c.txt")))), g.nodes.where("name = 'boot'"))
    assert sorted(map(tuple, g.viewed().collect()), key=repr) == sorted(map(tuple, by_hand.viewed().collect()), key=repr)
    g = read(facts + "omit boot\nonly --callees tick\nreset\n")
    assert g.labels.count() == 0 and sorted(map(tuple, g.viewed().collect()), key=repr) == sorted(map(tuple, g.reset_filter().viewed().collect()), key=repr)
    for wrong in ("omit\n", "reset boot\n", "keep --labels boot\n"):
        assert read(facts + wrong).rejects.count() == 1
        with pytest.raises(ValueError, match="not a command"):
            read(facts + wrong, strict=True)
    with pytest.raises(ValueError, match="not a command"):
        read(facts + "paint boot\n", strict=True)
    read("edge late idle\nnode late\n")
    with pytest.raises(ValueError, match="late"):
        read("edge late idle\nnode late\n", strict=True)


def test_first_definition_by_path(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"s{i:02d}.txt").write_text(f"node shared f{i}.c\n")
    g = readers.read_script(spark, str(tmp_path / "*.txt"))
    assert [r["file"] for r in g.nodes.collect()] == ["f0.c"]


def test_compile_database(spark, tmp_path):
    entry = {"directory": "/w", "command": "cc -std=c99 -DX='a b' -c test.c", "file": "test.c", "output": "test.o"}
    (tmp_path / "db.json").write_text(json.dumps([entry | {"command": "old"}, entry, entry | {"output": "/abs/o.o"}]))
    got = {r["object_file"]: (r["absolute_path"], r["command"]) for r in readers.compile_database(spark, str(tmp_path / "db.json")).collect()}
    assert got["/w/test.o"] == ("/w/test.c", ["cc", "-std=c99", "-DX=a b", "-c", "test.c"]) and set(got) == {"/w/test.o", "/abs/o.o"}
    (tmp_path / "bad.json").write_text(json.dumps([{"directory": "/w"}]))
    with pytest.raises(ValueError):
        readers.compile_database(spark, str(tmp_path / "bad.json"))
    objects = spark.createDataFrame([("/w/test.o",)], "object_file string")
    files = spark.createDataFrame([("/w/test.o.229r.expand",), ("/w/other.o.1r.expand",)], "path string")
    assert [tuple(r) for r in readers.dumps_of(objects, files).collect()] == [("/w/test.o", "/w/test.o.229r.expand")]
    with pytest.raises(ValueError):
        readers.dumps_of(objects, files.where("false"))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, text in enumerate(("node a f.c\nedge a b call", "node b f.c\nedge b c ref")):
        (tmp_path / "in" / f"{k}.txt").write_text(text)
        q = incremental.collect_facts(incremental.script_stream(spark, str(tmp_path / "in")), str(tmp_path / "facts"), str(tmp_path / "state"))
        q.awaitTermination(120)
        g = incremental.current(spark, str(tmp_path / "facts"))
        assert g.edges.count() == k + 1
    assert sorted(r["n"] for r in g.all_nodes(False).select(display().alias("n")).collect()) == ["a", "b"]
