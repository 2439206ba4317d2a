"""The graph queries over the derived graph, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import described, display, kind
from ..graph import CallGraph
from ..operators import closure, neighbours, views
from ..operators.automata import ANY, Automaton, One, Seq, matches
from ..operators.paths import paths, printed
from ..operators.select import Label, Predicate, Where
from ..operators.spec import pattern, selection
from ..sinks import writers
from ..sources import readers
from ..sources.facts import REJECTS, history
from ..sources.store import Store
from . import derived
from .tables import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIP = Label("VIP")


def query(sql: str, base: str = derived.SQL):
    """Register a function of the graph under its name, with its SQL after the graph's tables."""

    def register(f: Callable[[CallGraph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(derived.derived(spark, sf_dir))
        SQL[f.__name__] = base + sql
        return f

    return register


def _nodes(graph: CallGraph, chosen: DataFrame) -> DataFrame:
    return graph.named(chosen)


@query(" SELECT count(*) AS n FROM node")
def node_count(g):
    return g.nodes.agg(F.count("*").alias("n"))


@query(" SELECT id, name FROM named WHERE NOT external")
def nodes_visible(g):
    return g.all_nodes(False).select("id", display().alias("name"))


@query(" SELECT id, name FROM named")
def nodes_with_external(g):
    return g.all_nodes(True).select("id", display().alias("name"))


@query(" SELECT DISTINCT file FROM node WHERE file IS NOT NULL")
def files(g):
    return g.all_files()


@query(" SELECT id, name FROM named WHERE file = 'NATION_7.o'")
def nodes_for_file(g):
    return g.nodes_for_file("NATION_7.o").select("id", display().alias("name"))


@query(" SELECT id, CASE WHEN file IS NULL THEN name ELSE concat(name, ' (', file, ')') END AS text FROM named")
def node_format(g):
    return g.nodes.select("id", described().alias("text"))


@query(" SELECT src, dst, CASE WHEN is_call THEN 'call' ELSE 'ref' END AS type FROM edge")
def edge_types(g):
    return g.edges.select("src", "dst", kind().alias("type"))


@query(" SELECT e.src, e.dst FROM edge e JOIN node d ON d.id = e.dst WHERE e.is_call OR NOT d.external")
def has_edge_ref(g):
    return g.filter_edge(g.edges, ref_ok=True)


@query(" SELECT count(*) AS edges, count(*) FILTER (WHERE is_call) AS calls, count(DISTINCT (src, dst)) AS pairs FROM edge")
def merge_call_wins(g):
    return g.edges.agg(F.count("*").alias("edges"), F.count_if("is_call").alias("calls"), F.countDistinct("src", "dst").alias("pairs"))


def _callers_sql(ref: bool) -> str:
    rule = "(e.is_call OR NOT d.external)" if ref else "e.is_call"
    return f""" SELECT s.name AS caller, string_agg(d.name, ', ' ORDER BY d.name) AS callees
        FROM edge e JOIN named s ON s.id = e.src JOIN named d ON d.id = e.dst
        WHERE {rule} AND e.dst IN (SELECT id FROM vip) GROUP BY s.id, s.name"""


def _callees_sql(external: bool, ref: bool) -> str:
    rule = ("TRUE" if ref else "e.is_call") + ("" if external else " AND NOT d.external")
    return f""" SELECT d.name AS callee, string_agg(s.name, ', ' ORDER BY s.name) AS callers
        FROM edge e JOIN named s ON s.id = e.src JOIN named d ON d.id = e.dst
        WHERE {rule} AND e.src IN (SELECT id FROM vip) GROUP BY d.id, d.name"""


@query(_callers_sql(False))
def callers_call(g):
    return neighbours.callers_report(g, VIP.ids(g), ref_ok=False)


@query(_callers_sql(True))
def callers_ref(g):
    return neighbours.callers_report(g, VIP.ids(g), ref_ok=True)


@query(_callees_sql(False, False))
def callees_call(g):
    return neighbours.callees_report(g, VIP.ids(g))


@query(_callees_sql(False, True))
def callees_ref(g):
    return neighbours.callees_report(g, VIP.ids(g), ref_ok=True)


@query(_callees_sql(True, False))
def callees_external(g):
    return neighbours.callees_report(g, VIP.ids(g), external_ok=True)


@query(_callees_sql(True, True))
def callees_ref_external(g):
    return neighbours.callees_report(g, VIP.ids(g), external_ok=True, ref_ok=True)


_DOWN = ", down AS (SELECT id FROM vip UNION SELECT e.dst FROM down r JOIN edge e ON e.src = r.id)"
_UP = ", up AS (SELECT id FROM vip UNION SELECT e.src FROM up r JOIN edge e ON e.dst = r.id)"


@query(_DOWN + " SELECT id FROM down")
def all_callees(g):
    return closure.all_callees(g, VIP.ids(g))


@query(_UP + " SELECT id FROM up")
def all_callers(g):
    return closure.all_callers(g, VIP.ids(g))


def matching(name: str, spec: str, sql: str) -> None:
    """Register the selection of a text as a query: id and display name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = derived.derived(spark, sf_dir)
        return _nodes(g, selection(spec).ids(g))

    QUERIES[name] = run
    SQL[name] = f"{derived.SQL}{sql}"


def _where(condition: str) -> str:
    return f" SELECT n.id, n.name FROM named n WHERE {condition}"


def _has(label: str) -> str:
    return f"n.id IN (SELECT id FROM lab WHERE label = '{label}')"


_CALLED = "n.id IN (SELECT e.dst FROM edge e WHERE e.is_call AND {}) AND NOT n.external"
_CALLING = "n.id IN (SELECT e.src FROM edge e WHERE e.is_call AND {})"
matching("match_name_alias", '"cust_20()" "Customer#000000020" "Customer#000000011" nobody', _where("n.id IN (SELECT id FROM node WHERE username = 'cust_20()' OR name IN ('Customer#000000020', 'Customer#000000011'))"))
matching("match_regex", "/^cust_1.*0\\\\(/", _where("regexp_matches(n.name, '^cust_1.*0\\(')"))
matching("match_label", "[VIP]", _where(_has("VIP")))
matching("match_and", "[VIP,BUILDING,/[05]$/]", _where(f"{_has('VIP')} AND {_has('BUILDING')} AND regexp_matches(n.name, '[05]$')"))
matching("match_or", "[VIP|BUILDING] /1$/", _where(f"{_has('VIP')} OR {_has('BUILDING')} OR regexp_matches(n.name, '1$')"))
matching("match_not", "[!VIP,!BUILDING]", _where(f"NOT {_has('VIP')} AND NOT {_has('BUILDING')}"))
matching("match_all", "[]", " SELECT id, name FROM named")
matching("match_callers", "[VIP]:callers", _where(_CALLING.format("e.dst IN (SELECT id FROM vip)")))
matching("match_callees", "[VIP]:callees", _where(_CALLED.format("e.src IN (SELECT id FROM vip)")))
matching("match_negated_step", "[!VIP:callees]", _where(_CALLED.format("e.src NOT IN (SELECT id FROM vip)")))
matching("match_nested", "[VIP:callers:callees,!VIP]", _where(f"NOT {_has('VIP')} AND " + _CALLED.format("e.src IN (SELECT src FROM edge WHERE is_call AND dst IN (SELECT id FROM vip))")))
matching("match_all_callers", "[VIP]:all_callers", f"{_UP} SELECT n.id, n.name FROM named n JOIN up ON up.id = n.id")
matching("match_all_callees", "[VIP]:all_callees", f"{_DOWN} SELECT n.id, n.name FROM named n JOIN down ON down.id = n.id")


def walking(name: str, spec: str, first: str, step: str, final: str, external: bool = True, ref: bool = False, count: int | None = None) -> None:
    """Register a path query. first and step give the next state of n (null: none) from v (its VIP label), l (its segment) and p.state."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = derived.derived(spark, sf_dir)
        found = paths(g, pattern(spec), external_ok=external, ref_ok=ref, limit=count)
        return found.agg(F.count("*").alias("n"), F.max("length").alias("longest")) if count else printed(found)

    out = f"SELECT count(*) AS n, max(length) AS longest FROM (SELECT * FROM found ORDER BY length LIMIT {count})" if count else "SELECT path, length FROM found"
    QUERIES[name] = run
    SQL[name] = f"""{derived.SQL},
n AS (SELECT d.id, d.name, d.id IN (SELECT id FROM vip) AS v, (SELECT min(label) FROM lab WHERE lab.id = d.id AND label <> 'VIP') AS l
      FROM named d{'' if external else ' WHERE NOT d.external'}),
p AS (SELECT [n.id] AS ids, [n.name] AS names, n.id AS at, {first} AS state FROM n WHERE {first} IS NOT NULL
      UNION ALL
      SELECT list_append(p.ids, n.id), list_append(p.names, n.name), n.id, {step} FROM p JOIN edge e ON e.src = p.at JOIN n ON n.id = e.dst
      WHERE {'TRUE' if ref else 'e.is_call'} AND NOT list_contains(p.ids, n.id) AND {step} IS NOT NULL),
found AS (SELECT array_to_string(list_reverse(names), ' <- ') AS path, CAST(len(names) AS INTEGER) AS length FROM p WHERE {final})
{out}"""


_VIP_FIRST = "CASE WHEN n.v THEN 1 END"
walking("paths_fixed", "[VIP] [] [BUILDING]", _VIP_FIRST, "CASE WHEN p.state = 1 THEN 2 WHEN p.state = 2 AND n.l = 'BUILDING' THEN 3 END", "state = 3")
walking("paths_star", "[VIP] ... [VIP]", _VIP_FIRST, "CASE WHEN n.v THEN 2 ELSE 1 END", "state = 2")
walking("paths_alt", "[VIP] ([BUILDING] [] | [MACHINERY])", _VIP_FIRST, "CASE WHEN p.state = 1 AND n.l = 'BUILDING' THEN 2 WHEN p.state = 1 AND n.l = 'MACHINERY' THEN 3 WHEN p.state = 2 THEN 3 END", "state = 3")
walking("paths_label_gap", "[VIP] [!VIP]* [VIP]", _VIP_FIRST, "CASE WHEN p.state = 1 AND n.v THEN 2 WHEN p.state = 1 THEN 1 END", "state = 2")
walking("paths_ref", "[VIP] [!VIP,BUILDING] []", _VIP_FIRST, "CASE WHEN p.state = 1 AND NOT n.v AND n.l = 'BUILDING' THEN 2 WHEN p.state = 2 THEN 3 END", "state = 3", ref=True)
walking("paths_no_external", "[VIP] ... [VIP]", _VIP_FIRST, "CASE WHEN n.v THEN 2 ELSE 1 END", "state = 2", external=False)
walking("paths_limit", "[VIP] ... [VIP]", _VIP_FIRST, "CASE WHEN n.v THEN 2 ELSE 1 END", "state = 2", count=10)


@query(" SELECT n.name, string_agg(l.label, ', ' ORDER BY l.label) AS labels FROM lab l JOIN named n ON n.id = l.id GROUP BY n.id, n.name")
def labels_per_node(g):
    return neighbours.labels_report(g, None)


@query(" SELECT n.id, n.name FROM named n JOIN vip ON vip.id = n.id")
def labeled_nodes(g):
    return g.labeled_nodes("VIP")


@query(" SELECT id, name FROM named WHERE NOT external AND id NOT IN (SELECT id FROM vip)")
def omit_node_view(g):
    return views.omit(g, VIP.ids(g)).all_nodes(False).select("id", display().alias("name"))


@query(""", kept AS (SELECT vip.id FROM vip JOIN lab ON lab.id = vip.id AND lab.label = 'BUILDING')
    SELECT id, name FROM named WHERE id NOT IN (SELECT id FROM vip) OR id IN (SELECT id FROM kept)""")
def keep_over_omit(g):
    hidden = views.omit(g, VIP.ids(g))
    return views.keep(hidden, (VIP & Label("BUILDING")).ids(hidden)).all_nodes(True).select("id", display().alias("name"))


@query(""" SELECT d.name AS callee, string_agg(s.name, ', ' ORDER BY s.name) AS callers
    FROM edge e JOIN named s ON s.id = e.src JOIN named d ON d.id = e.dst
    WHERE e.is_call AND NOT d.external AND e.dst IN (SELECT id FROM lab WHERE label IN ('VIP', 'BUILDING')) GROUP BY d.id, d.name""")
def only_view(g):
    shown = views.only(views.only(g, VIP.ids(g)), Label("BUILDING").ids(g))
    return neighbours.callees_report(shown, None)


def _isolated_sql(targets: str, hidden: str, near: str) -> str:
    """Nodes that stay visible once the edges of targets are hidden and what that leaves alone is omitted."""
    return f"""{targets},
    open AS (SELECT e.src, e.dst, e.is_call OR NOT d.external AS listed FROM edge e JOIN node d ON d.id = e.dst WHERE {hidden} NOT IN (SELECT id FROM t)),
    near AS (SELECT id FROM t UNION SELECT {near}),
    gone AS (SELECT id FROM near WHERE id NOT IN (SELECT dst FROM open WHERE listed) AND id NOT IN (SELECT src FROM open))
    SELECT id, name FROM named WHERE id NOT IN (SELECT id FROM gone)"""


_FEW = ", t AS (SELECT vip.id FROM vip JOIN lab ON lab.id = vip.id AND lab.label = 'BUILDING')"


@query(_isolated_sql(_FEW, "e.dst", "src FROM edge WHERE dst IN (SELECT id FROM t)"))
def omit_callers_view(g):
    few = (VIP & Label("BUILDING")).ids(g)
    return views.omit_callers_of(g, few).all_nodes(True).select("id", display().alias("name"))


@query(_isolated_sql(_FEW, "e.src", "dst FROM edge WHERE src IN (SELECT id FROM t)"))
def omit_callees_view(g):
    few = (VIP & Label("BUILDING")).ids(g)
    return views.omit_callees_of(g, few).all_nodes(True).select("id", display().alias("name"))


@query(_UP.replace("FROM vip", "FROM vip") + _isolated_sql(", t AS (SELECT id FROM up)", "e.dst", "src FROM edge WHERE dst IN (SELECT id FROM t)"))
def omit_callers_recursive(g):
    return views.omit(g, VIP.ids(g), callers=True).all_nodes(True).select("id", display().alias("name"))


_QUOTED = "CASE WHEN regexp_matches({0}, '^[^\\s\"#]+$') THEN {0} ELSE concat('\"', {0}, '\"') END"
_STRICT = "CASE WHEN regexp_matches({0}, '^[A-Za-z0-9_.]+$') THEN {0} ELSE concat('\"', {0}, '\"') END"


@query(f""", q AS (SELECT id, {_QUOTED.format('name')} AS word, {_STRICT.format('name')} AS strict, {_QUOTED.format('file')} AS file, external FROM named)
    SELECT CASE WHEN external THEN concat('node --external ', word) ELSE concat_ws(' ', 'node', word, file) END AS line FROM q
    UNION ALL SELECT concat('label ', lab.label, ' ', q.strict) FROM lab JOIN q ON q.id = lab.id
    UNION ALL SELECT concat('edge ', s.word, ' ', d.word, CASE WHEN e.is_call THEN ' call' ELSE ' ref' END) FROM edge e JOIN q s ON s.id = e.src JOIN q d ON d.id = e.dst""")
def save_script(g):
    return writers.script_lines(g).select("line")


@query(" SELECT s.name AS src_name, d.name AS dst_name FROM edge e JOIN named s ON s.id = e.src JOIN named d ON d.id = e.dst WHERE e.is_call AND NOT d.external")
def dot_edges(g):
    return writers.dot_edges(g).select("src_name", "dst_name")


@query(""", drawn AS (SELECT e.src, e.dst FROM edge e JOIN node d ON d.id = e.dst WHERE e.is_call AND NOT d.external)
    SELECT id, name FROM named WHERE NOT external AND id NOT IN (SELECT src FROM drawn) AND id NOT IN (SELECT dst FROM drawn)""")
def dot_isolated(g):
    return writers.dot_isolated(g)


@query(" SELECT file, string_agg(name, ', ' ORDER BY name) AS members FROM named WHERE file IS NOT NULL GROUP BY file")
def dot_clusters(g):
    return writers.dot_clusters(g).select("file", F.array_join("members", ", ").alias("members"))


#: The uses and definitions of derived.dump_lines in their order; a use stands for what its name meant by then.
_DUMPED = """, used AS (
  SELECT row_number() OVER (ORDER BY s.file, e.src, e.dst, k.head) AS ord, k.head, s.name AS symbol, s.username, d.name AS target, e.is_call
  FROM (SELECT src, dst, is_call, FALSE AS head FROM edge UNION ALL SELECT id, 0, FALSE, TRUE FROM node WHERE NOT external) e
  CROSS JOIN LATERAL (SELECT e.head) k JOIN node s ON s.id = e.src LEFT JOIN named d ON d.id = e.dst),
told AS (SELECT username AS alias, ord, symbol FROM used WHERE head AND username IS NOT NULL),
meant AS (SELECT u.symbol AS caller, coalesce(t.symbol, u.target) AS callee, u.is_call FROM used u ASOF LEFT JOIN told t ON t.alias = u.target AND t.ord < u.ord WHERE NOT u.head)"""


def _named_edges(g: CallGraph) -> DataFrame:
    ends = [g.nodes.select(F.col("id").alias(x), F.col("name").alias(n)) for x, n in (("src", "caller"), ("dst", "callee"))]
    return g.edges.join(ends[0], "src").join(ends[1], "dst").select("caller", "callee", "is_call")


@query(_DUMPED + " SELECT caller, callee, bool_or(is_call) AS is_call FROM meant GROUP BY caller, callee")
def dump_as_of(g):
    """Dumps cut into splits, with pretty names that mean something only from their definition on."""
    return _named_edges(history(readers.dump_facts(derived.dump_lines(g))).at())


@query(_DUMPED + """ SELECT name, bool_and(external) AS external FROM (
      SELECT name, FALSE AS external FROM node WHERE NOT external UNION ALL SELECT callee, TRUE FROM meant) GROUP BY name""")
def dump_nodes(g):
    return history(readers.dump_facts(derived.dump_lines(g))).at().nodes.select("name", "external")


def _scripted(g: CallGraph) -> CallGraph:
    return readers.graph_of(readers.script_source(derived.script_text(g)))


@query(" SELECT s.name AS caller, d.name AS callee, e.is_call FROM edge e JOIN node s ON s.id = e.src JOIN node d ON d.id = e.dst")
def script_edges(g):
    return _named_edges(_scripted(g))


@query(""" SELECT concat('cannot add edge from external node: ', name) AS reason FROM node WHERE external AND id % 4 = 0
    UNION ALL SELECT concat('not a command of a graph: node --hidden ', name) FROM node WHERE id % 9 = 0""")
def script_rejects(g):
    return _scripted(g).rejects.select("reason")


@query(" SELECT name FROM node WHERE NOT (name LIKE '%5' AND id <= 70)")
def script_omit_at_its_place(g):
    """omit hides what is there by then, not what later lines define."""
    return _scripted(g).all_nodes(True).select("name")


@query(" SELECT name, 'late' AS label FROM node WHERE id % 5 = 0")
def script_labels(g):
    """A label goes to names that earlier lines know, and to no others."""
    out = _scripted(g)
    return out.labels.join(out.nodes, "id").select("name", "label")


@query(" SELECT s.name AS caller, d.name AS callee, e.is_call FROM edge e JOIN node s ON s.id = e.src JOIN node d ON d.id = e.dst")
def grown_edges(g):
    """A graph loaded in three parts, the callers' definitions, their calls as far as they lead to even ids, and the rest."""
    spark = g.spark
    ends = [g.nodes.select(F.col("id").alias(x), F.col("name").alias(n)) for x, n in (("src", "name"), ("dst", "target"))]
    edges = g.edges.join(ends[0], "src").join(ends[1], "dst")
    parts = [
        g.nodes.where("not external").select(*readers._fact("node", ord=F.col("id"), name=F.col("name"), file=F.col("file"))),
        edges.where("dst % 2 = 0").select(*readers._fact("edge", ord=F.xxhash64("src", "dst").bitwiseAND(0xFFFFFFFF), name=F.col("name"), target=F.col("target"), is_call=F.col("is_call"), checked=F.lit(True))),
        edges.select(*readers._fact("edge", ord=F.xxhash64("src", "dst").bitwiseAND(0xFFFFFFFF), name=F.col("name"), target=F.col("target"), is_call=F.col("is_call"), checked=F.lit(True))),
    ]
    store = Store(spark, scratch(spark, "store"), buckets=8)
    for part in parts:
        store.load(readers.Source(part, spark.createDataFrame([], REJECTS)))
    return _named_edges(store.graph())


_NEXT = """, pair AS (SELECT DISTINCT CAST(a.o_custkey AS BIGINT) AS src, CAST(b.o_custkey AS BIGINT) AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    after = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").cast("long").alias("dst"))
    return orders.select("o_orderkey", F.col("o_custkey").cast("long").alias("src")).join(after, "o_orderkey").select("src", "dst").distinct()


def edge_types_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of pairs of which most are no edges."""
    return derived.derived(spark, sf_dir).edge_type(_pairs(spark, sf_dir))


QUERIES["edge_types_of_pairs"] = edge_types_of_pairs
SQL["edge_types_of_pairs"] = f"{derived.SQL}{_NEXT} SELECT p.src, p.dst, CASE WHEN e.is_call THEN 'call' ELSE 'ref' END AS type FROM pair p LEFT JOIN edge e ON e.src = p.src AND e.dst = p.dst"


@query(" SELECT id, name FROM named")
def reset_filter_view(g):
    hidden = views.only(views.omit(g, VIP.ids(g), callers=True), Label("BUILDING").ids(g))
    return hidden.reset_filter().all_nodes(True).select("id", display().alias("name"))


@query(f""" SELECT n.id, n.name, 'NEAR' AS label FROM named n WHERE {_CALLING.format('e.dst IN (SELECT id FROM vip)')}""")
def label_selection(g):
    """label with a selection, after all labels were reset."""
    out = g.add_label(VIP.callers().ids(g), "OLD").reset_labels().add_label(VIP.callers().ids(g), "NEAR")
    return out.labels.join(out.named(out.labels), "id").select("id", "name", "label")


@query(" SELECT id, name FROM named WHERE length(name) % 2 = 0 AND name LIKE '%0%'")
def match_predicates(g):
    """Own predicates, one of Spark's functions and one in Python."""
    return g.named((Where(lambda c: F.length(c) % 2 == 0) & Predicate(lambda name: "0" in name)).ids(g))


def walked(name: str, made: Automaton, first: str, step: str, final: str) -> None:
    """Register paths of an automaton made by hand; see `walking` for the SQL."""
    walking(name, "[]", first, step, final)
    QUERIES[name] = lambda spark, sf_dir: printed(paths(derived.derived(spark, sf_dir), made, external_ok=True))


_EVEN = Automaton([(0, VIP, 1), (1, VIP, 0), (0, ~VIP & Label("BUILDING"), 0), (1, ~VIP & Label("BUILDING"), 1)], {0}, {0})
walked("paths_even", _EVEN, "CASE WHEN n.v THEN 1 WHEN n.l = 'BUILDING' THEN 0 END", "CASE WHEN n.v THEN 1 - p.state WHEN n.l = 'BUILDING' THEN p.state END", "state = 0")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the customers of ten orders in a row, as names, begin with one of BUILDING and hold a VIP later."""
    g = derived.derived(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("long").alias("id"))
    named = orders.join(g.nodes.select("id", display().alias("name")), "id")
    rows = named.groupBy(F.floor(F.col("o_orderkey") / 10).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "name"))), lambda x: x["name"]).alias("names"))
    return matches(g, rows, "names", Seq((One(Label("BUILDING")), ANY, One(VIP), ANY))).select("block", "accepted")


QUERIES["sequences"] = sequences
SQL["sequences"] = f"""{derived.SQL}, row AS (
  SELECT CAST(floor(o.o_orderkey / 10) AS BIGINT) AS block, row_number() OVER (PARTITION BY floor(o.o_orderkey / 10) ORDER BY o.o_orderkey, n.name) AS k,
         n.id IN (SELECT id FROM vip) AS v, n.id IN (SELECT id FROM lab WHERE label = 'BUILDING') AS b
  FROM orders o JOIN named n ON n.id = o.o_custkey)
SELECT block, bool_or(k = 1 AND b) AND bool_or(k > 1 AND v) AS accepted FROM row GROUP BY block"""
