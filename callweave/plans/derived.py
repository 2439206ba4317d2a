"""A call graph derived from order tables: customers call whoever placed the next order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import display
from ..graph import CallGraph


def derived(spark: SparkSession, sf_dir: str) -> CallGraph:
    """Nodes are customers (external if in debt), edges lead from an urgent order's customer to the next order's, labels are market segments and VIP."""
    customer, nation, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "orders"))
    debt = F.col("c_acctbal") < 0
    nodes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"),
        F.when(~debt & (F.col("c_custkey") % 10 == 0), F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"), F.lit("()"))).alias("username"),
        F.when(~debt, F.concat("n_name", F.lit(".o"))).alias("file"), F.lit(None).cast("int").alias("line"), debt.alias("external"),
    )
    urgent = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus in ('F', 'P')").select((F.col("o_orderkey") + 1).alias("next"), F.col("o_custkey").alias("src"), "o_orderstatus")
    after = orders.select(F.col("o_orderkey").alias("next"), F.col("o_custkey").alias("dst"))
    callers = nodes.where("not external").select(F.col("id").alias("src"))
    edges = urgent.join(after, "next").join(callers, "src", "left_semi").groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    edges = edges.agg((F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)) == 1).alias("is_call"))
    segments = customer.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("label"))
    vip = customer.where("c_acctbal > 9000").select(F.col("c_custkey").cast("long").alias("id"), F.lit("VIP").alias("label"))
    return CallGraph(nodes, edges, segments.unionByName(vip))


#: The same tables in SQL: node, edge, lab, and named (node with its display name).
SQL = """WITH RECURSIVE node AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS id, c.c_name AS name,
         CASE WHEN c.c_acctbal >= 0 AND c.c_custkey % 10 = 0 THEN concat('cust_', CAST(c.c_custkey AS VARCHAR), '()') END AS username,
         CASE WHEN c.c_acctbal >= 0 THEN concat(n.n_name, '.o') END AS file,
         c.c_acctbal < 0 AS external
  FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey),
named AS (SELECT id, coalesce(username, name) AS name, file, external FROM node),
edge AS (
  SELECT CAST(a.o_custkey AS BIGINT) AS src, CAST(b.o_custkey AS BIGINT) AS dst, max(CASE WHEN a.o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AS is_call
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1
  JOIN node s ON s.id = a.o_custkey AND NOT s.external
  WHERE a.o_orderpriority = '1-URGENT' AND a.o_orderstatus IN ('F', 'P')
  GROUP BY a.o_custkey, b.o_custkey),
lab AS (
  SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS label FROM customer
  UNION ALL SELECT CAST(c_custkey AS BIGINT), 'VIP' FROM customer WHERE c_acctbal > 9000),
vip AS (SELECT id FROM lab WHERE label = 'VIP')"""


def dump_lines(g: CallGraph) -> DataFrame:
    """The defined nodes of a derived graph as a compiler would dump them, a file for each nation: (file, start, at, value), see `readers.lines`.

    Callees are named as the graph shows them; those over 500 stand in a split after that of their function.
    """
    names = g.nodes.select(F.col("id").alias("dst"), display().alias("target"))
    defined = g.nodes.where("not external")
    path = F.concat(F.regexp_replace("file", r"\.o$", ""), F.lit(".1r.expand"))
    head = F.when(F.col("username").isNull(), F.concat(F.lit(";; Function "), "name")).otherwise(F.concat(F.lit(";; Function "), "username", F.lit(" ("), "name", F.lit(", funcdef_no=1)")))
    heads = defined.select(path.alias("file"), (2 * F.col("id")).alias("start"), (F.col("id") * 10_000_000).alias("at"), head.alias("value"))
    calls = g.edges.join(defined.select(F.col("id").alias("src"), "file"), "src").join(names, "dst")
    insn = F.concat(F.when(F.col("is_call"), "(call_insn 1 (call (mem (symbol_ref:DI (\"").otherwise('(insn 1 (set (symbol_ref:DI ("'), "target", F.lit('") [flags])'))
    calls = calls.select(path.alias("file"), (2 * F.col("src") + (F.col("dst") > 500).cast("long")).alias("start"), (F.col("src") * 10_000_000 + F.col("dst")).alias("at"), insn.alias("value"))
    return heads.unionByName(calls)


def script_text(g: CallGraph) -> DataFrame:
    """Command lines (file, start, at, value) over a derived graph, its nodes in the order of their ids, an edge after both its ends: some are wrong, and some act on what is there by then."""
    def lines(df: DataFrame, at: Column, value: Column) -> DataFrame:
        return df.select(F.lit("script").alias("file"), F.lit(0).cast("long").alias("start"), at.cast("long").alias("at"), value.alias("value"))

    step = 100_000_000
    node = F.when(F.col("external"), F.concat(F.lit("node --external "), "name")).otherwise(F.concat_ws(" ", F.lit("node"), "name", "file"))
    nodes = lines(g.nodes, F.col("id") * step, node)
    wrong = lines(g.nodes.where("external and id % 4 = 0"), F.col("id") * step + 1, F.concat(F.lit("edge "), "name", F.lit(" anyone")))
    odd = lines(g.nodes.where("id % 9 = 0"), F.col("id") * step + 2, F.concat(F.lit("node --hidden "), "name"))
    early = lines(g.nodes.where("id % 3 = 0"), F.col("id") * step - 1, F.concat_ws(" ", F.lit("label early"), "name"))  # before the node: labels nothing
    ghost = lines(g.nodes.where("id % 5 = 0"), F.col("id") * step + 3, F.concat_ws(" ", F.lit("label late"), "name"))
    ends = [g.nodes.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name")) for x in ("src", "dst")]
    edge = g.edges.join(ends[0], "src").join(ends[1], "dst")
    edges = lines(edge, F.greatest("src", "dst") * step + 10 + F.least("src", "dst"), F.concat_ws(" ", F.lit("edge"), "src_name", "dst_name", F.when(F.col("is_call"), "call").otherwise("ref")))
    half = lines(g.nodes.where("id = 70"), F.lit(70 * step + 4), F.lit("omit /5$/"))
    return reduce(DataFrame.unionByName, (nodes, wrong, odd, early, ghost, edges, half))
