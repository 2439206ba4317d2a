"""Joins that spread hot keys, dropped rows, shipping, and the stages' contract."""

import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from callweave.llm import common


@pytest.mark.parametrize("most", [64 << 20, 20, 3], ids=["broadcast", "salted", "plain"])
@pytest.mark.parametrize("hot", [256, 2, 1])
def test_spread_join(spark, hot, most, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    rows = spark.range(900).select("id", F.when(F.col("id") < 600, "often").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("key <> 'k7'")
    found = common.spread_join(rows, groups, "key", "n", F.col("id"), hot).collect()
    first = {r["key"]: (r["n"], r["first"]) for r in groups.collect()}
    assert len(found) == 900 and all((r["n"], r["first"]) == first.get(r["key"], (None, None)) for r in found)
    assert common.spread_join(rows.where("false"), groups.where("false"), "key", "n", F.col("id"), hot).count() == 0


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("more", [0, 300])
def test_spread_join_of_known_size(spark, hot, more):
    """Where the caller knows the sizes' sum, or more, nothing is counted first and the rows are the same."""
    rows = spark.range(900).select("id", F.when(F.col("id") < 600, "often").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("key <> 'k7'")
    want = common.spread_join(rows, groups, "key", "n", F.col("id"), hot)
    ran = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    found = common.spread_join(rows, groups, "key", "n", F.col("id"), hot, total=900 + more)
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() == ran
    assert found.columns == want.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_hot_rows_are_dealt_out(spark):
    """Rows of a key that holds most of them don't meet in one partition."""
    rows = spark.range(4000).select("id", F.lit("one").alias("key"))
    groups = spark.createDataFrame([("one", 4000)], "key string, n long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("-1", "false", "8"), strict=True):
        spark.conf.set(k, v)
    try:
        parts = common.spread_join(rows, groups, "key", "n", F.col("id")).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(parts) == 8 and max(r["count"] for r in parts) < 700


def test_passing(spark):
    with common.passing(spark):
        with common.passing(spark):
            kept, gone = common.written(spark.range(3), "kept", keep=True), common.written(spark.range(4), "gone")
            assert gone.count() == 4
        assert kept.count() == 3
        with pytest.raises(Exception, match="(?i)not_exist|not exist"):
            spark.read.parquet(*gone.inputFiles()).count()
        last = common.written(kept, "last", keep=True)
    assert last.count() == 3
    with pytest.raises(Exception, match="(?i)not_exist|not exist"):
        spark.read.parquet(*kept.inputFiles()).count()


@pytest.mark.parametrize("few", [200_000, 0])
def test_without(spark, few, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None), (3, "")], "doc_id long, text string")
    dropped = docs.where("doc_id = 1 and text = 'a' or doc_id is null or doc_id = 3").select(common.row_key().alias("key"))
    assert sorted(map(tuple, common.without(docs, dropped, common.row_key()).collect())) == [(1, "b"), (2, None)]


def test_ship(spark, monkeypatch):
    sent = []
    monkeypatch.setenv("PYTHONPATH", "/elsewhere")
    monkeypatch.setattr(common, "_shipped", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    common.ship(spark)
    common.ship(spark)
    assert len(sent) == 1 and "callweave/llm/common.py" in zipfile.ZipFile(sent[0]).namelist()


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
