"""Readers of compiler dumps, command scripts, compile databases and saved tables, each giving facts or a graph."""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import EDGES, LABELS, NODES, CallGraph
from ..operators import views
from ..operators.ordered import carried, offset
from ..operators.spec import SpecError, selection
from ..plans.commits import latest, matching
from ..plans.tables import written
from .facts import FACTS, REJECTS, History, history

# The lines of a compiler's expansion dump.
_HEAD = ";; Function "
_NAMED = r"^(.+) \(([^ ,()]+)[,)]"  # a pretty name, then the symbol at the start of a bracket
_SYMBOL = r'\(symbol_ref\S*\s+\("([^"]+)"'
_DUMP = r"^(.*?)\.[0-9]*r\.expand"
_WORD = r'"(?:\\.|[^"\\])*"|\S+'


@dataclass(frozen=True)
class Source:
    """What was read: facts (FACTS), what was refused (REJECTS), and commands (ord, file, line, value) that act on the graph at their place."""

    facts: DataFrame
    rejects: DataFrame
    commands: DataFrame | None = None


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, at, value): the lines of text files. A file is read in splits that begin at start, at ascends within each."""
    return numbered_lines(located(spark.read.text(path)))


def located(text: DataFrame) -> DataFrame:
    """(file, start, value) of text files that are read, or arrive as a stream."""
    file = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    return text.select(file.alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def numbered_lines(text: DataFrame) -> DataFrame:
    """What `located` gives of files or of a stream's batch, as `lines`."""
    return text.select("file", "start", F.monotonically_increasing_id().alias("at"), "value")


def _fact(kind: str, **columns: Column) -> list[Column]:
    given = {"kind": F.lit(kind), "external": F.lit(False), "is_call": F.lit(True), "checked": F.lit(False)} | columns
    return [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in FACTS.split(", "))]


def _ordered(rows: DataFrame) -> DataFrame:
    """rows, a written table with file, start and at, with ord and line: files one after another by their paths, lines in order within them.

    The order comes from one row for each split of a file. line counts the lines of the file that are among rows.
    """
    splits = rows.groupBy("file", "start").agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + 1).alias("span"))
    splits = offset(splits, ["file", "start"], "span", "base")
    splits = splits.withColumn("above", F.min("base").over(Window.partitionBy("file")))
    found = rows.join(splits.drop("span"), ["file", "start"]).withColumn("ord", F.col("base") + F.col("at") - F.col("first"))
    return found.withColumn("line", F.col("ord") - F.col("above") + 1).drop("first", "base", "above")


def dump_facts(text: DataFrame, object_name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Facts of dump lines (see `lines`): functions, and their calls and references to symbols.

    Only the first symbol of a line counts; it is a call if the line holds "(call". The function of a line is the last one that the
    file began before it: splits are scanned on their own, and the last function of each is carried into the next ones. The file label is the
    dump's name up to the pass number, with ".o". Only names are kept and shuffled, not lines.
    """
    name = object_name or (lambda f: F.concat(F.regexp_extract(F.element_at(F.split(f, "/"), -1), _DUMP, 1), F.lit(".o")))
    v = F.col("value")
    head, rest = v.startswith(_HEAD), F.rtrim(F.substring(v, len(_HEAD) + 1, 1 << 30))
    plain, symbol = rest.rlike(r"^\S+$"), F.regexp_extract(rest, _NAMED, 2)
    own = F.when(head & plain, rest).when(head & (symbol != ""), symbol)
    shown = F.when(head & ~plain & (symbol != ""), F.regexp_extract(rest, _NAMED, 1))
    target = F.when(~head, F.nullif(F.regexp_extract(v, _SYMBOL, 1), F.lit("")))
    rows = text.select("file", "start", "at", own.alias("own"), shown.alias("shown"), target.alias("target"), v.contains("(call").alias("is_call"))
    rows = _ordered(written(rows.where("own is not null or target is not null"), "dump")).withColumn("fn", F.col("own"))
    nodes = rows.where("own is not null").select(*_fact("node", ord=F.col("ord"), name=F.col("own"), username=F.col("shown"), file=name(F.col("file"))))
    rows = carried(rows, "file", "start", ["ord"], "fn").where("target is not null and fn is not null")
    return nodes.unionByName(rows.select(*_fact("edge", ord=F.col("ord"), name=F.col("fn"), target=F.col("target"), is_call=F.col("is_call"))))


def _refused(df: DataFrame, reason: Column | str) -> DataFrame:
    return df.select("ord", "file", "line", (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def script_source(text: DataFrame) -> Source:
    """Facts and commands of command lines (see `lines`), and the lines that are neither.

    node [--external] NAME [FILE], edge CALLER CALLEE [call|ref] and label LABEL NAME... are facts; an edge's caller must be defined by an earlier
    line, a label goes to names that earlier lines know. omit, keep and only with [--callers] [--callees] SELECTION, reset [--filters]
    [--labels] and label LABEL SELECTION are commands. Words may be in double quotes; lines that begin with # are comments. Any other line is refused, the rest goes on.
    """
    rows = _ordered(written(text, "script")).withColumn("text", F.trim(F.regexp_replace("value", r"\s", " ")))
    rows = rows.where((F.col("text") != "") & ~F.col("text").startswith("#"))
    raw = F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1))
    bare = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r"\\(.)", "$1")).otherwise(x)
    rows = rows.withColumns({"command": F.get(raw, F.lit(0)), "raw": F.slice(raw, 2, 1 << 30)})
    rows = rows.withColumns({"flags": F.filter("raw", lambda x: x.startswith("--")), "args": F.filter("raw", lambda x: ~x.startswith("--"))})
    marked = F.exists("args", lambda x: x.rlike(r"^[\[\]()|!/]|^[\w.]+:(all_)?calle(rs|es)"))
    c, n, flags = F.col("command"), F.size("args"), F.col("flags")
    only = lambda *known: F.size(F.array_except(flags, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))) == 0
    external = F.array_contains("flags", "--external")
    picks = c.isin("omit", "keep", "only") | (c == "label") & marked
    fits = (
        F.when(c == "node", only("--external") & n.between(1, 2)).when(c == "edge", only() & n.between(2, 3) & F.coalesce(F.get("args", F.lit(2)).isin("call", "ref"), F.lit(True)))
        .when(c == "label", only() & (n > 1)).when(c == "reset", only("--filters", "--labels") & (n == 0)).when(picks, only("--callers", "--callees") & (n > 0)).otherwise(False)
    )
    filed = (c == "node") & external & (n == 2)
    rows = written(rows.select("ord", "file", "line", "text", "command", external.alias("external"), F.transform("args", bare).alias("w"), fits.alias("fits"), picks.alias("picks"), filed.alias("filed")), "parsed")

    good, w = rows.where("fits and not filed"), F.col("w")
    nodes = good.where("command = 'node'").select(*_fact("node", ord=F.col("ord"), name=w[0], file=F.get("w", F.lit(1)), external=F.col("external")))
    edges = good.where("command = 'edge'").select(*_fact("edge", ord=F.col("ord"), name=w[0], target=w[1], is_call=F.coalesce(F.get("w", F.lit(2)), F.lit("call")) == "call", checked=F.lit(True)))
    labels = good.where("command = 'label' and not picks").select("ord", w[0].alias("label"), F.explode(F.slice("w", 2, 1 << 30)).alias("name"))
    labels = labels.select(*_fact("label", ord=F.col("ord"), name=F.col("name"), label=F.col("label"), checked=F.lit(True)))
    commands = good.where("picks or command = 'reset'").select("ord", "file", "line", F.col("text").alias("value"))
    wrong = _refused(rows.where("not fits"), F.concat(F.lit("not a command of a graph: "), "text"))
    return Source(nodes.unionByName(edges).unionByName(labels), wrong.unionByName(_refused(rows.where("fits and filed"), "file not allowed for external symbols")), commands)


def script_facts(text: DataFrame) -> DataFrame:
    """The facts of `script_source`."""
    return script_source(text).facts


@dataclass
class Replay:
    """The view and labels that commands leave behind, each carried out on the graph of the facts before it."""

    history: History
    marks: DataFrame | None = None
    default: bool = True
    #: Labels given before this ord are gone.
    reset: int = -1

    def __post_init__(self):
        self.labels: list[DataFrame] = []
        self.refused: list[tuple] = []

    def graph(self, ord: int | None = None) -> CallGraph:
        known = self.history.labels.where(F.col("created") > self.reset)
        known = known if ord is None else known.where(F.col("created") < ord)
        labels = reduce(DataFrame.unionByName, self.labels, known).select("id", "label").distinct()
        return replace(self.history.at(ord), labels=labels, marks=self.marks, default=self.default)

    def run(self, commands: DataFrame) -> Replay:
        """Carry out commands (ord, file, line, value) in their order. They come to the driver one by one, as they do from a user; a selection that can't be
        read is refused, and the rest goes on."""
        for row in commands.orderBy("ord").toLocalIterator():
            command, *words = re.findall(_WORD, row["value"])
            flags = {w[2:] for w in words if w.startswith("--")}
            words = [w for w in words if not w.startswith("--")]
            graph = self.graph(row["ord"])
            try:
                chosen = selection(" ".join(words[command == "label" :])).ids(graph) if command != "reset" else None
            except SpecError as e:
                self.refused.append((row["ord"], row["file"], row["line"], str(e)))
                continue
            if command == "reset":
                if flags != {"labels"}:
                    self.marks, self.default = None, True
                if flags != {"filters"}:
                    self.labels, self.reset = [], row["ord"]
            elif command == "label":
                named = chosen.select("id", F.lit(words[0].strip('"')).alias("label"), F.lit(row["ord"]).cast("long").alias("created"))
                self.labels.append(written(named, "labelled"))
            else:
                act = {"omit": views.omit, "keep": views.keep, "only": views.only}[command]
                out = act(graph, chosen, callers="callers" in flags, callees="callees" in flags)
                self.marks, self.default = out.marks, out.default
        return self

    def rejects(self) -> DataFrame:
        return self.history.nodes.sparkSession.createDataFrame(self.refused, REJECTS)



def graph_of(source: Source, strict: bool = False) -> CallGraph:
    """The graph of what was read, with what was refused as its rejects; strict: anything refused raises ValueError."""
    found = history(source.facts)
    played = Replay(found)
    if source.commands is not None:
        played.run(source.commands)
    rejects = written(found.rejects.unionByName(source.rejects).unionByName(played.rejects()), "rejects")
    wrong = rejects.orderBy("ord").limit(5).collect() if strict else []
    if wrong:
        raise ValueError("; ".join(r["reason"] for r in wrong))
    return replace(played.graph(), rejects=rejects)


def compile_database(spark: SparkSession, path: str) -> DataFrame:
    """(object_file, absolute_path, directory, command): one row per object file, the last entry's.

    Paths are absolute; command is an array of words as a shell splits them.
    """
    raw = spark.read.schema("directory string, file string, command string, output string").json(path, multiLine=True)
    raw = raw.select("*", F.monotonically_increasing_id().alias("n"))
    missing = raw.where("directory is null or file is null or command is null or output is null")
    if not missing.isEmpty():
        raise ValueError("every entry of a compile database needs directory, file, command and output")

    def absolute(c: str) -> Column:
        return F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat_ws("/", "directory", c))

    @F.pandas_udf("array<string>")
    def words(commands: pd.Series) -> pd.Series:  # a shell's quoting has no built-in
        return commands.map(shlex.split)

    last = raw.select("n", absolute("output").alias("object_file"), absolute("file").alias("absolute_path"), "directory", "command")
    last = last.groupBy("object_file").agg(F.max_by(F.struct("absolute_path", "directory", "command"), "n").alias("e"))
    return last.select("object_file", "e.absolute_path", "e.directory", words("e.command").alias("command"))


def _dumps(objects: DataFrame, files: DataFrame) -> DataFrame:
    """(object_file, dumps, reason): all expansion dumps among files (path) of each object file, and why they aren't just one."""
    found = files.select(F.col("path").alias("dump"), F.regexp_extract("path", r"^(.*)\.[^/]*r\.expand$", 1).alias("object_file"))
    found = objects.select("object_file").join(found, "object_file", "left").groupBy("object_file").agg(F.array_sort(F.collect_set("dump")).alias("dumps"))
    why = F.when(F.size("dumps") == 0, F.concat("object_file", F.lit(": no dump file"))).when(F.size("dumps") > 1, F.concat("object_file", F.lit(": more than one dump file: "), F.array_join("dumps", ", ")))
    return found.withColumn("reason", why)


def dumps_of(objects: DataFrame, files: DataFrame) -> DataFrame:
    """(object_file, dump): the one expansion dump among files (path) of each object file; none or several raise ValueError."""
    found = _dumps(objects, files)
    wrong = found.where("reason is not null").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(r["reason"] for r in wrong))
    return found.select("object_file", F.col("dumps")[0].alias("dump"))


def _of_objects(spark: SparkSession, objects: list[str], compdb: str | None) -> tuple[list[str], list[tuple[str, str]]]:
    """The dumps of object files that a compile database knows, and why others have none. Names are listed by tasks and joined; no dump is opened."""
    if not objects:
        return [], []
    asked = spark.createDataFrame([(o,) for o in sorted(set(objects))], "object_file string")
    known = compile_database(spark, compdb).select("object_file") if compdb else asked.limit(0)
    folders = sorted({o.rpartition("/")[0] or "." for o in objects})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*r.expand").load(folders).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    found = _dumps(asked.join(known, "object_file", "left_semi"), files).collect()
    lost = [(r[0], f"could not find '{r[0]}' in the compile database") for r in asked.join(known, "object_file", "left_anti").collect()]
    return [r["dumps"][0] for r in found if r["reason"] is None], lost + [(r["object_file"], r["reason"]) for r in found if r["reason"]]


def _paths(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """The paths that are there, globs spelt out, and those that aren't."""
    found = {p: matching(spark, p) for p in ([path] if isinstance(path, str) else path)}
    return sorted({f for own in found.values() for f in own}), [(p, "no such file") for p, own in found.items() if not own]


def _with(spark: SparkSession, made: Source, wrong: list[tuple[str, str]]) -> Source:
    """made, and whole files (file, reason) that were refused."""
    whole = spark.createDataFrame([(None, file, None, reason) for file, reason in wrong], REJECTS)
    return replace(made, rejects=made.rejects.unionByName(whole))


def dump_files(spark: SparkSession, path: str | list[str], compdb: str | None = None) -> Source:
    """Facts of expansion dumps, of folders of them, and of the dumps of object files (.o) by a compile database. What isn't there, has another name than a dump, or
    has no dump or several, is refused; all others are read."""
    given = [path] if isinstance(path, str) else list(path)
    dumps, lost = _of_objects(spark, [p for p in given if p.endswith(".o")], compdb)
    found, missing = _paths(spark, [p for p in given if not p.endswith(".o")])
    files = [unquote(f) for f in spark.read.text(found).inputFiles()] if found else []
    named = re.compile(_DUMP)
    odd = [f for f in files if not named.match(f.rpartition("/")[2])]
    good = [f for f in files if named.match(f.rpartition("/")[2])] + dumps
    facts_ = dump_facts(lines(spark, good)) if good else spark.createDataFrame([], FACTS)
    return _with(spark, Source(facts_, spark.createDataFrame([], REJECTS)), lost + missing + [(f, "not the name of a dump") for f in odd])


def script_files(spark: SparkSession, path: str | list[str]) -> Source:
    found, missing = _paths(spark, path)
    text = lines(spark, found) if found else spark.createDataFrame([], "file string, start long, at long, value string")
    return _with(spark, script_source(text), missing)


def read_dumps(spark: SparkSession, path: str | list[str], compdb: str | None = None) -> CallGraph:
    return graph_of(dump_files(spark, path, compdb))


def read_script(spark: SparkSession, path: str | list[str], strict: bool = False) -> CallGraph:
    """The graph of command scripts, what `script_source` refuses beside it. strict: anything refused raises ValueError."""
    return graph_of(script_files(spark, path), strict)


def read_tables(spark: SparkSession, path: str) -> CallGraph:
    """The three tables that `save_tables` committed last."""
    number, manifest = latest(spark, path)
    if not number:
        raise ValueError(f"no graph was saved at {path}")
    return CallGraph(*(spark.read.schema(s).parquet(f"{manifest['data']}/{t}") for t, s in (("nodes", NODES), ("edges", EDGES), ("labels", LABELS))))


#: Readers by name; own ones may be added.
READERS: dict[str, Callable[..., CallGraph]] = {"rtl": read_dumps, "script": read_script, "tables": read_tables}
#: Readers whose facts can be added to a graph that is there already.
SOURCES: dict[str, Callable[..., Source]] = {"rtl": dump_files, "script": script_files}


def load(spark: SparkSession, format: str, path: str | list[str], **options) -> CallGraph:
    if format not in READERS:
        raise ValueError(f"unknown format '{format}'; known are {', '.join(sorted(READERS))}")
    return READERS[format](spark, path, **options)
