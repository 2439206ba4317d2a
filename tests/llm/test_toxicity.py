"""Toxicity on held-out labels and odd texts."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import labelled, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = toxicity.score(docs, model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert len(rows) > 20
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.9


def area(scores, y):
    """The chance that a toxic text scores higher than another; ties count half."""
    a, b = scores[y == 1][:, None], scores[y == 0][None, :]
    return ((a > b) + 0.5 * (a == b)).mean()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_area_under_curve(spark, sf):
    docs, labels = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    found = toxicity.examples(docs, labels, "toxic", toxicity.PER_CLASS)
    held = docs.join(labels, "doc_id").where(labelled.fold("doc_id") == 0).select("text", "toxic").collect()
    y = np.array([r["toxic"] for r in held])
    for seed in (7, 8):
        made = toxicity.train(found.column("text").to_pylist(), found.column("label").to_pylist(), seed=seed)
        words = toxicity.Words(made.weights)
        means = [toxicity.window_means(words.of(toxicity.tokens(r["text"]))) for r in held]
        scores = made.score(np.array([m.max() for m in means]) + made.bias, np.array([len(m) for m in means]))
        assert made.scale[0] > 0 and area(scores, y) > 0.85
        assert ((scores >= 0.5) == y).mean() > 0.93 and (scores[y == 1] >= 0.5).mean() > 0.6 and (scores[y == 0] >= 0.5).mean() < 0.03


def plainly(text, model):
    """The score by loops over words, windows and n-grams."""
    each = []
    for token in toxicity.tokens(text):
        marked, word = f"<{toxicity.bare(token)}>", toxicity.bare(token)
        buckets = [(zlib.crc32(word.encode()) * 0xD6E8FEB86659FD93 % 2**64) >> 47]
        for size in (3, 4, 5):
            for i in range(len(marked) - size + 1):
                gram = 0
                for c in marked[i : i + size]:
                    gram = (gram * 0x9E3779B97F4A7C15 + ord(c) + 1) % 2**64
                buckets.append(((gram ^ size << 58) * 0xD6E8FEB86659FD93 % 2**64) >> 47)
        each.append(sum(float(model.weights[b]) for b in buckets) / len(buckets))
    windows = [each[i : i + 3] for i in range(max(1, len(each) - 2))]
    best = max(sum(w) / len(w) if w else 0.0 for w in windows) + model.bias
    z = model.scale[0] * best + model.scale[1] * np.log(len(windows)) + model.scale[2]
    return 1 / (1 + np.exp(-z))


def test_scores_by_brute_force(spark, model):
    texts = ["", "you worthless idiot", "Trash!!! ***", "one", "a" * 45 + " scum, " + "b" * 81, "été déjà vu clown de la " * 5, "x y\tz\nw " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        assert r["score"] == pytest.approx(plainly(texts[r["doc_id"]], model), abs=1e-5)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.op1_toxicity(spark, sf)
    rows, ids = found.collect(), [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids) and dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_sample_is_bounded(spark, monkeypatch):
    """Repeated ids and large texts don't widen the sample."""
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 2000)
    docs = spark.range(4000).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 7).alias("text")).unionByName(spark.range(300, 400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long "), 60).alias("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).distinct()
    found = labelled.examples(docs, labels, "toxic", 1000)
    ids = found.column("id").to_pylist()
    assert len(ids) == len(set(ids)) and 0 < sum(len(t) for t in found.column("text").to_pylist()) <= 2000
    monkeypatch.setattr(labelled, "LONGEST_EXAMPLE", 100)
    assert max(labelled.examples(docs, labels, "toxic", 1000).column("id").to_pylist()) < 40


def test_inputs_and_folds(spark, model):
    docs = spark.createDataFrame([(1, "you worthless idiot scum", "en"), (1, "you worthless idiot scum", "en"), (2, "", ""), (3, None, None), (None, "plain " * 30000, ""), (5, "x" * 90000, "x"), (6, "*** !!! \n", "")], "doc_id long, text string, score string")
    found = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()}
    by = dict(found)
    assert by[1] > 0.5 and by[2] == by[3] and all(0 <= s <= 1 for s in by.values()) and len(found) == 6
    held = {r["doc_id"]: r["held_out"] for r in toxicity.score(docs, model).collect()}
    assert all(held[i] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i in held)
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_misspelled(model):
    """A word that was never seen shares n-grams with a known one."""
    seen = toxicity.Words(model.weights).of(["idiot", "idiooot", "idiots", "window", "garden"])
    assert min(seen[:3]) > max(seen[3:])


def test_never_learns_held_out(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    found = toxicity.examples(docs, labels, "toxic", 1000)
    assert set(found.column("id").to_pylist()) == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}


def test_one_label():
    one = toxicity.train(["a"] * 20, [0] * 20)
    assert one.score(toxicity.np.array([0.0]), toxicity.np.array([1]))[0] < 0.5
    assert toxicity.train([], []).score(toxicity.np.array([0.0]), toxicity.np.array([1]))[0] == 0.5
