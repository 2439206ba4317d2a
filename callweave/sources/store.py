"""A call graph that grows: each load merges its facts into bucketed tables and becomes visible at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import MARKS, CallGraph
from ..plans.commits import commit, latest, unused
from ..plans.tables import written
from .facts import ALIASES, EDGE_HISTORY, LABEL_HISTORY, NODE_HISTORY, REJECTS, History, history
from .readers import SOURCES, Replay, Source

#: Each table's schema and the columns whose hash gives a row's bucket.
TABLES = {"nodes": (NODE_HISTORY, ["name"]), "edges": (EDGE_HISTORY, ["src", "dst"]), "labels": (LABEL_HISTORY, ["id", "label"]), "aliases": (ALIASES, ["alias"])}


class Store:
    """The history of a graph in a folder: nodes, edges, labels and pretty names, each cut into buckets by a hash of its key.

    A load reads the buckets that its names fall into, and writes those that it changes, as new files; a manifest, committed last, says for each bucket where it
    is. So ids never change, buckets that a load doesn't touch stay as they are, and who reads meanwhile, or after a load that failed, sees the last committed
    version. The number of buckets is set by the first load; choose it so that a task can hold one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path
        self.version, manifest = latest(spark, path)
        fresh = {"buckets": buckets, "next_ord": 0, "next_id": 0, "tables": {name: {} for name in TABLES}, "rejects": [], "marks": None, "default": True, "reset": -1, "batches": {}}
        self.manifest = manifest or fresh

    def bucket(self, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.manifest["buckets"])).cast("int")

    def table(self, name: str, touched: list[int] | None = None) -> DataFrame:
        """A table's rows, of the touched buckets alone if they are given."""
        schema, _ = TABLES[name]
        at = self.manifest["tables"][name]
        paths = [f"{at[b]}/{name}/bucket={b}" for b in at if touched is None or int(b) in touched]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, df: DataFrame, columns: list[str]) -> list[int]:
        """The buckets of df's keys; as many numbers as there are buckets at most."""
        return [r[0] for r in df.select(self.bucket(columns)).distinct().collect()]

    def known(self, symbols: DataFrame) -> DataFrame:
        """The nodes (NODE_HISTORY) of symbols (symbol)."""
        names = symbols.select(F.col("symbol").alias("name"))
        return self.table("nodes", self.touched(names, ["name"])).join(names, "name", "left_semi").select(*(c.split()[0] for c in NODE_HISTORY.split(", ")))

    def told(self, names: DataFrame) -> DataFrame | None:
        """The pretty names (ALIASES) among names (alias); None if the graph has none at all."""
        return self.table("aliases", self.touched(names, ["alias"])).join(names, "alias", "left_semi") if self.manifest["tables"]["aliases"] else None

    def history(self) -> History:
        empty = self.spark.createDataFrame([], REJECTS)
        return History(self.table("nodes"), self.table("edges"), self.table("labels"), self.table("aliases"), empty)

    def _view(self) -> dict:
        marks = self.manifest["marks"]
        return {"marks": self.spark.read.schema(MARKS).parquet(marks) if marks else None, "default": self.manifest["default"], "reset": self.manifest["reset"]}

    def graph(self) -> CallGraph:
        """The graph of everything that was committed, in the view that the commands so far have left, with all that was refused."""
        return replace(Replay(self.history(), **self._view()).graph(), rejects=self.rejects())

    def rejects(self) -> DataFrame:
        found = self.manifest["rejects"]
        return self.spark.read.schema(REJECTS).parquet(*found) if found else self.spark.createDataFrame([], REJECTS)

    def _write(self, name: str, delta: DataFrame, data: str, merge) -> None:
        """Merge delta, a written table, into the buckets that it touches."""
        _, key = TABLES[name]
        touched = self.touched(delta, key)
        if not touched:
            return
        whole = merge(self.table(name, touched).unionByName(delta)).withColumn("bucket", self.bucket(key))
        whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{data}/{name}")
        self.manifest["tables"][name] = self.manifest["tables"][name] | {str(b): data for b in touched}

    def load(self, source: Source, batch: tuple[str, int] | None = None) -> Store:
        """Add what was read to the graph: the same as if all loads had been one batch of facts, one after another.

        batch, the name of a stream and the number of its batch, makes a load that was committed before one that does nothing.
        """
        if batch and self.manifest["batches"].get(batch[0], -1) >= batch[1]:
            return self
        before = self.manifest
        self.manifest = before | {"tables": dict(before["tables"])}
        try:
            return self._load(source, batch)
        except BaseException:
            self.manifest = before
            raise

    def _load(self, source: Source, batch: tuple[str, int] | None) -> Store:
        first, data = self.manifest["next_ord"], unused(self.path)
        later = lambda df: df.withColumn("ord", F.col("ord") + first)
        new = history(later(source.facts), self.known if self.manifest["tables"]["nodes"] else None, self.told, self.manifest["next_id"])

        def of_nodes(rows: DataFrame) -> DataFrame:
            # Of a node's two rows at most, the earlier one is of an external node and holds nothing but its name.
            return rows.groupBy("id", "name").agg(*(F.max(c).alias(c) for c in ("username", "file", "line")), F.min("created").alias("created"), F.max("defined").alias("defined"))

        self._write("nodes", new.nodes, data, of_nodes)
        self._write("edges", new.edges, data, lambda rows: rows.groupBy("src", "dst").agg(F.min("created").alias("created"), F.min("called").alias("called")))
        self._write("aliases", new.aliases, data, lambda rows: rows)
        labels, rejects = new.labels, new.rejects.unionByName(later(source.rejects))
        if source.commands is not None:
            commands = written(later(source.commands), "commands")
            if not commands.isEmpty():
                whole = replace(self.history(), labels=self.table("labels").unionByName(new.labels))
                played = Replay(whole, **self._view()).run(commands)
                if played.marks is not None:
                    played.marks.write.parquet(f"{data}/marks")
                self.manifest |= {"marks": f"{data}/marks" if played.marks is not None else None, "default": played.default, "reset": played.reset}
                for more in played.labels:
                    labels = labels.unionByName(more)
                rejects = rejects.unionByName(played.rejects())
        alive = F.col("created") > self.manifest["reset"]
        labels = written(labels.where(alive), "new-labels")
        self._write("labels", labels, data, lambda rows: rows.where(alive).groupBy("id", "label").agg(F.min("created").alias("created")))
        rejects.write.parquet(f"{data}/rejects")
        others = source.rejects.select("ord") if source.commands is None else source.rejects.select("ord").unionByName(source.commands.select("ord"))
        last = others.agg(F.max("ord")).first()[0]
        ords = [new.last, None if last is None else last + first]
        self.manifest |= {
            "next_ord": max([first, *(x + 1 for x in ords if x is not None)]), "next_id": max(self.manifest["next_id"], -1 if new.top is None else new.top + 1), "rejects": [*self.manifest["rejects"], f"{data}/rejects"],
            "batches": self.manifest["batches"] | ({batch[0]: batch[1]} if batch else {}),
        }
        commit(self.spark, self.path, self.version + 1, self.manifest)
        self.version += 1
        return self


def load_into(store: Store, format: str, path: str | list[str], **options) -> Store:
    """Add files to a graph that is there already, or to an empty one."""
    if format not in SOURCES:
        raise ValueError(f"unknown format '{format}'; known are {', '.join(sorted(SOURCES))}")
    return store.load(SOURCES[format](store.spark, path, **options))
