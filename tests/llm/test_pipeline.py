"""Each stage against brute force on a small table with copies, nulls and odd rows."""

import hashlib
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from callweave.llm import pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(900001, None, None, None, 0), (900002, "", "en", "s", 0), (None, "no id " * 20, "en", "s", 1), (900003, "no id " * 20, "en", "s", 1), (900003, "no id " * 20, "en", "s", 1), (900003, "other text with the same id", "en", "s", 1), (900004, "long " + " ".join(f"w{i}" for i in range(30000)), "en", "s", 1), (900005, "mail a.b@c.de", "en", "s", 1)]
    return own.unionByName(spark.createDataFrame(odd, own.schema))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def alike(found, size=5, similarity=0.8):
    """The rows that stay, by comparing the shingle sets of all pairs."""
    sets = []
    for r in found:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r["text"] or "").encode()))
        sets.append({b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    top = list(range(len(found)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    rank = [(r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in found]
    best = {}
    for k in range(len(found)):
        best[find(k)] = min(best.get(find(k), rank[k]), rank[k])
    return sorted((tuple(r) for k, r in enumerate(found) if best[find(k)] == rank[k]), key=repr)


def test_clashing_columns(spark, docs):
    """Columns of odd names go through each stage as they are and change no decision."""
    some = docs.where("doc_id is null or doc_id < 40 or doc_id > 900000")
    names = ["key", "drop", "_drop", "tag", "id", "row", "other", "hash", "node", "Key", "host", "path", "kept", "found", "label", "start"]
    extra = some.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names if n != "Key"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, SF)
        assert got.columns == extra.columns, name
        assert rows(got.select(*some.columns)) == rows(stage(spark, some, SF)), name
        assert got.where("doc_id is not null and key <> concat('key', doc_id)").isEmpty()
    plain = corpus_pipeline.packed(spark, some, SF)
    assert rows(corpus_pipeline.packed(spark, extra, SF).drop("sequence_id", "offset")) == rows(plain.drop("sequence_id", "offset"))


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == docs.columns and set(rows(kept)) <= set(rows(docs)) and kept.count() > 0.7 * docs.count()

    once = stages["exact_dedup"](spark, docs, SF)
    best = {}
    for r in docs.collect():
        rank = (r["doc_id"] is None, r["doc_id"])
        best[r["text"] or ""] = min(best.get(r["text"] or "", (rank, tuple(r))), (rank, tuple(r)), key=lambda x: x[0])
    assert rows(once) == sorted((r for _, r in best.values()), key=repr)

    near = stages["near_dedup"](spark, docs, SF)
    assert near.columns == docs.columns and rows(near) == alike(docs.collect())

    clean = stages["personal_data"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == docs.count() and clean.schema["n_chars"] == docs.schema["n_chars"]
    by = {r["doc_id"]: r["text"] for r in clean.where("doc_id > 900003").collect()}
    assert by[900005] == "mail <email>"


def test_quality(spark, docs):
    """Rows that go are those that the operator judges so, whatever repeats."""
    kept = corpus_pipeline.good_quality(spark, docs, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = quality.judge(docs, model, F.col("source"), F.col("lang"), carry=docs.columns).where("kept").select("row.*")
    assert rows(kept) == rows(judged)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in kept.collect()}
    known = [(labels[r["doc_id"]], r["doc_id"] in stay) for r in docs.select("doc_id").collect() if labels.get(r["doc_id"]) is not None]
    assert sum(k == s for k, s in known) > 0.85 * len(known)


def test_personal_data(spark, docs):
    """Every text with its spans replaced one by one, those that overlap as one."""
    def replaced(text, spans):
        out, at, merged = "", 0, []
        for kind, start, end in spans:
            if merged and start < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], end)
            else:
                merged.append([kind, start, end])
        for kind, start, end in merged:
            out, at = f"{out}{text[at:start]}<{kind}>", end
        return out + text[at:]

    found = pii.find(docs).select("row.*", "found").collect()
    want = [(r["doc_id"], r["text"] and replaced(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["found"]]), r["lang"], r["source"]) for r in found]
    clean = corpus_pipeline.personal_data(spark, docs, SF)
    assert rows(clean.select("doc_id", "text", "lang", "source")) == sorted(want, key=repr) and sum(len(r["found"]) for r in found) > 20
    assert clean.where("not (n_chars <=> length(text))").isEmpty()


def test_packing(spark, docs):
    """All ids of all documents, each once, in sequences without gaps."""
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces, ends = {}, {}
    for r in corpus_pipeline.packed(spark, some, SF).orderBy("doc_id", "start").collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in some.select("doc_id", "text").collect():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in pieces.pop(doc_id):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{p['length']}I", *ids[at : at + p["length"]]))
            at += p["length"]
        assert at == len(ids)
    assert not pieces and all(sum(n for _, n in own) <= 2048 and all(o == sum(n for q, n in own if q < o) for o, _ in own) for own in ends.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "doc_id" and out.count() > 100


def test_empty(spark, docs):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
