"""Encoders against the libraries' own results on whole texts, and round trips."""

import functools
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm import bpe, packing, subwords, token_output

BYTE, WORD, MULTI = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "\n", "Hello, world!\nIt's 12345 o'clock.", "a  b\n\n c ", "tab\tand\r\nreturn", "nb sp 　wide ­soft", "naïve ÉCOLE ßtraße 日本語 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> <|startoftext|>", "one <|endoftext|>two, <|ENDOFTEXT|>.\n <|endoftext|> \n", "stop. go, on!\nnext; é: ß? 3, x!, end.", "x" * 5000, "\0nul \x01one", "it 's don't", "é combining", "word " * 3000, "﻿bom", "A1b2-c3_d4", " lead", "trail ", "\nline", "line\n", "1 ½ ٣"]
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,!1aBé日ß ́\0"), st.characters(exclude_categories=["Cs"])), max_size=60)


@functools.cache
def library(path):
    if path == MULTI:
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=subwords.read_ranks(path), special_tokens={})
        return own.encode_ordinary
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return lambda t: made.encode(t, add_special_tokens=False).ids


def encoder(path):
    return subwords.encoder(path, P.PATTERN if path == MULTI else None, " \x01 " if path == WORD else "\n")


@pytest.mark.parametrize("path", [BYTE, WORD, MULTI])
def test_same_ids(path):
    want = library(path)
    for texts in (TEXTS, TEXTS):
        ids, n = encoder(path).encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [list(want(t)) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD, MULTI])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=4))
def test_same_ids_for_any_text(path, texts):
    ids, n = encoder(path).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [list(library(path)(t)) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD, MULTI])
def test_small_table_and_long_texts(path, monkeypatch):
    """What a worker forgets, and where long texts are cut, changes no ids; the table stays within its bound."""
    monkeypatch.setattr(subwords, "SEGMENT", 200)
    made = subwords.Encoder(subwords.tokenizer_of(path, P.PATTERN if path == MULTI else None), " \x01 " if path == WORD else "\n", most=40_000)
    for turn in range(20):
        texts = [" ".join(f"word{i}x{chr(97 + i % 26)}, Ab{chr(97 + turn)}" + "c" * (i % 7) for i in range(turn * 20, turn * 20 + 60)) + ".\n" + TEXTS[turn] * 9 for _ in range(2)]
        ids, n = made.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [list(library(path)(t)) for t in texts]
        assert made.held <= 20_000 and sum(180 + len(k) + len(v) for k, v in made.old.items()) <= 20_000 + 180 * 400


def test_one_encoder_a_worker():
    assert subwords.encoder(BYTE) is subwords.encoder(BYTE)
    assert subwords.encoder(WORD, mark=" \x01 ") is not subwords.encoder(BYTE) and len(subwords._last) == 1


def rows(spark, texts):
    return spark.createDataFrame([(i * 7 % 1000, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def test_round_trip(spark):
    docs = rows(spark, [*TEXTS, None, "again", "again"])
    found = {r["doc_id"]: r for r in bpe.encode(docs, MULTI, P.PATTERN, ("n_tokens", "ids", "offsets", "ids_sha256", "decoded_sha256")).collect()}
    assert len(found) == docs.count()
    for r in docs.collect():
        text, got = r["text"] or "", found[r["doc_id"]]
        assert got["ids"] == library(MULTI)(text) and got["n_tokens"] == len(got["ids"])
        assert got["ids_sha256"] == hashlib.sha256(np.array(got["ids"], "<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got["offsets"] == sorted(got["offsets"]) and (not got["offsets"] or got["offsets"][-1] < len(text.encode()))
    back = bpe.decode(bpe.encode(docs, MULTI, P.PATTERN, ("ids",)), MULTI)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert bpe.encode(docs.where("false"), MULTI, P.PATTERN).count() == 0


def test_split_character(spark):
    parts = spark.createDataFrame([(1, library(MULTI)("\U0001f600")[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: (r["decoded"], r["text"]) for r in bpe.decode(parts, MULTI).collect()}
    assert found[1][0] == "\U0001f600".encode()[: len(found[1][0])] and found[1][1] is None
    assert found[2] == (None, None) and found[3] == (b"", "")


def test_token_files(spark, tmp_path):
    docs = rows(spark, [*TEXTS, None]).repartition(3)
    path = str(tmp_path / "orc")
    token_output.write_tokens(docs, path, BYTE, end_id=0)
    start = 0
    want = []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*library(BYTE)(r["text"] or ""), 0], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.token_digests(spark, path).collect())) == want
    one = token_output.read_tokens(spark, path).where("doc_id = 21")
    assert "doc_id = 21" in one._jdf.queryExecution().toString() and one.count() == 1
    again = str(tmp_path / "again")
    token_output.write_tokens(docs.unionByName(docs.selectExpr("doc_id", "concat(text, 'x') AS text", "n_tokens")), again, BYTE, end_id=0)
    lines = [r for f in sorted(f for f in os.listdir(again) if f.endswith(".orc")) for r in spark.read.orc(f"{again}/{f}").collect()]
    want, start = [], 0
    for r in lines:
        want.append((r["doc_id"], start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())))
        start += len(r["ids"])
    assert [r["doc_id"] for r in lines] == sorted(r["doc_id"] for r in lines) and len(lines) == 2 * docs.count()
    assert sorted(map(tuple, token_output.token_digests(spark, again).collect())) == sorted(want)
    token_output.write_tokens(docs.where("false"), str(tmp_path / "none"), BYTE)
    assert token_output.token_digests(spark, str(tmp_path / "none")).count() == 0


def test_orc_footers(spark, tmp_path):
    """Files hold row indexes, Bloom filters and run-length encoded integers; a filter on an id reads one row group."""
    path = str(tmp_path / "orc")
    token_output.write_tokens(spark.range(20_000).selectExpr("id * 3 AS doc_id", "concat('w', id) AS text"), path, BYTE)
    orc, conf = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    for name in (f for f in os.listdir(path) if f.endswith(".orc")):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        assert reader.getRowIndexStride() == 1000
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert {(1, "BLOOM_FILTER_UTF8"), (1, "ROW_INDEX"), (3, "ROW_INDEX")} <= kinds
            assert [footer.getColumns(c).getKind().toString() for c in (1, 2, 3)] == ["DIRECT_V2"] * 3
        rows.close()
    one = token_output.read_tokens(spark, path).where("doc_id = 30003")
    assert one.count() == 1 and one.collect()[0]["ids"] == [*library(BYTE)("w10001"), 0]
    read = token_output.read_tokens(spark, path).where("doc_id = 30004")
    plan = read._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 1000


def test_left_overs_stay_bounded():
    """Remainders that fit no full bin don't pile up from window to window."""
    lengths = np.full(3000, 1100)
    pieces, waiting, used = packing.layout(lengths, 2048, False, most_left=2048 * 100)
    assert sum(lengths[i] - s for i, s in waiting) < 2048 and used == sum(p[2] for p in pieces) // 2048
    assert sum(p[2] for p in pieces) + sum(int(lengths[i]) - s for i, s in waiting) == lengths.sum()
    pieces, waiting, _ = packing.layout(lengths[:50], 2048, False, most_left=2048 * 100)
    assert not pieces and len(waiting) == 50


@pytest.mark.parametrize("capacity,window", [(64, 500), (2048, 1 << 22)])
def test_packing(spark, capacity, window):
    docs = rows(spark, [*TEXTS, None, *(f"w{i} " * (i * 13 % 90) for i in range(200))]).repartition(3)
    pieces = packing.pack(docs, WORD, capacity, 1, window_ids=window, with_ids=True).collect()
    want = {r["doc_id"]: [*library(WORD)(r["text"] or ""), 1] for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
        assert p["token_ids"] == want[p["doc_id"]][p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(want[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(np.array(p["token_ids"], "<u4").tobytes())
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0
            at += p["length"]
        assert at == len(want[doc])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    total = packing.padding(spark.createDataFrame(pieces), capacity).first()
    assert total["tokens"] == sum(map(len, want.values())) and total["padding"] == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=12), st.integers(1, 40))
def test_fill_is_closest(lengths, capacity):
    counts = np.bincount([n for n in lengths if n <= capacity], minlength=capacity + 1)
    used = packing.fill(counts, capacity)
    reach = {0}
    for n in lengths:
        reach |= {r + n for r in reach if r + n <= capacity}
    assert sum(n * k for n, k in used) == max(reach)
    assert all(0 < k <= counts[n] for n, k in used)
