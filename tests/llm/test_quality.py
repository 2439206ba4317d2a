"""Quality on held-out labels; shrinkage against the formulas; odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import labelled, quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.op10_quality(spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = found.join(labels, "doc_id").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0").collect()
    assert len(rows) > 20 and np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.9
    assert all(r["kept"] for r in rows if r["quality"] == 1)


def model(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(f"word{rng.integers(500)}" for _ in range(40)) for _ in range(100)]
    bad = [" ".join([f"word{rng.integers(500)}"] * 40) for _ in range(100)]
    return quality.train(good + bad, [1] * 100 + [0] * 100), good, bad


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_posteriors(spark, broadcast, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_PATHS", broadcast)
    made, good, bad = model(spark)
    rows = [(i, t, "a", "x") for i, t in enumerate(good[:60])] + [(100 + i, t, "b", "x") for i, t in enumerate(bad[:50])] + [(200, good[70], "b", "y"), (201, good[71], "c", "x"), (202, "", None, None), (203, None, None, None), (203, None, None, None), (204, "z" * 70000, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    found = quality.judge(docs, made, F.col("host"), F.col("path")).select("row.*", "doc_score", "host_quality", "path_quality", "score", "kept").collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    p = {r["doc_id"]: r["doc_score"] for r in found}
    host = {h: [p[r[0]] for r in rows if r[2] == h] for h in ("a", "b", "c", None)}
    overall = (sum(map(sum, host.values())) + 1) / (len(rows) + 2)
    for r in found:
        own = host[r["host"]]
        rate = sum(own) / len(own)
        assert min(rate, overall) - 1e-9 <= r["host_quality"] <= max(rate, overall) + 1e-9
        assert 0 < r["score"] < 1 and r["kept"] == (r["score"] >= 0.5)
    by = {r["doc_id"]: r for r in found}
    assert by[0]["path_quality"] > 0.9 and by[100]["path_quality"] < 0.3 and by[0]["kept"] and not by[100]["kept"]
    assert by[200]["doc_score"] > by[200]["path_quality"]  # the sparse path is drawn to its host
    assert quality.judge(docs.where("false"), made, F.col("host"), F.col("path")).count() == 0


def brute(rows, p, logits, strength_host, strength_path):
    """Posteriors by loops: a host around all documents, a path around its host, a document around its path's other documents."""
    mean = lambda own, m, around: (sum(own) + m * around) / (len(own) + m)
    overall = (sum(p) + 1) / (len(p) + 2)
    out = []
    for i, r in enumerate(rows):
        host = mean([p[j] for j, s in enumerate(rows) if s[2] == r[2]], strength_host, overall)
        own = [p[j] for j, s in enumerate(rows) if s[2:] == r[2:]]
        others = mean([p[j] for j, s in enumerate(rows) if s[2:] == r[2:] and j != i], strength_path, host)
        others = min(0.999, max(0.001, others))
        out.append((p[i], host, mean(own, strength_path, host), 1 / (1 + np.exp(-(logits[i] + np.log(others / (1 - others)))))))
    return out


def test_formulas(spark, monkeypatch):
    """All four figures of every document, by loops."""
    strengths = []
    of = quality._strength
    monkeypatch.setattr(quality, "_strength", lambda *a: strengths.append(of(*a)) or strengths[-1])
    made, good, bad = model(spark)
    made.prior = 0.7
    rows = [(i, (good if i % 3 else bad)[i % 100], "abcd"[i % 4] if i % 10 else None, "xyz"[i % 3]) for i in range(150)] + [(150, None, "e", None), (151, "", "e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    found = {r["doc_id"]: r for r in quality.judge(docs, made, F.col("host"), F.col("path")).select("row.doc_id", "doc_score", "host_quality", "path_quality", "score", "kept").collect()}
    logits = made.logits([r[1] or "" for r in rows])
    p = 1 / (1 + np.exp(-(logits + np.log(0.7 / 0.3))))
    for i, want in enumerate(brute(rows, p.tolist(), logits.tolist(), *strengths)):
        got = found[i]
        assert (got["doc_score"], got["host_quality"], got["path_quality"], got["score"]) == pytest.approx(want, abs=1e-9)
        assert got["kept"] == (got["score"] >= 0.5)


def test_prior_leaves_out_fold_0(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    labels = docs.select("doc_id", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1).otherwise((F.col("doc_id") % 4 == 0).cast("int")).alias("quality"))
    rest = [r["quality"] for r in labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0").collect()]
    assert quality.fit(docs, labels).prior == pytest.approx(np.mean(rest))


def test_no_labels():
    assert quality.train(["a"], [1]).logits(["a", ""]).tolist() == [0.0, 0.0]


def test_fit_brings_features_alone(spark, monkeypatch):
    """Texts of the sample stay with the tasks; the model is the one that they train."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labelled.examples(docs, labels, "quality", quality.PER_CLASS)
    brought, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: brought.append(dict(self.dtypes)) or to_arrow(self))
    made = quality.fit(docs, labels)
    assert brought == [{"id": "bigint", "label": "int", "x": "array<double>"}]
    want = quality.train(known.column("text").to_pylist(), known.column("label").to_pylist(), made.prior)
    assert all((getattr(made, c) == getattr(want, c)).all() for c in ("mean", "spread", "weights"))
