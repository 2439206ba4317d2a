"""The registered queries that SQL can't express, on all documents of the smallest tables, against libraries and loops."""

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from test_dedup import components_of, plain_fingerprint
from test_pii import base, listed
from tokenizers import Tokenizer

from callweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op4(spark, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got, start = {r.doc_id: r for r in queries.op4_token_output(spark, SF).collect()}, 0
    assert set(got) == set(texts)
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)


def test_op5(spark, texts):
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    total = 0
    for doc_id, text in texts.items():
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(packed(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
        total += at
    padded = 0
    for own in sequences.values():
        end = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= 2048
        padded += 0 if end & (end - 1) == 0 else 2048 - end
    assert padded <= total // 100


def test_op6(spark, texts):
    got = {r.doc_id: r for r in queries.op6_pii(spark, SF).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        want, r = base(text), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, listed(want).split(","))) <= set(r.spans.split(","))


def test_op7(spark, texts):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    assert set(got) == set(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text, disallowed_special=())
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op8(spark, texts):
    order = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in order]
    bits = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :])
    of = components_of(len(order), np.argwhere(np.triu(bits <= 2, 1)).tolist())
    want = [(i, f"{f:016x}", order[c]) for i, f, c in zip(order, fps, of, strict=True)]
    assert sorted(map(tuple, queries.op8_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect())) == want
    assert len(set(of)) < len(order)
