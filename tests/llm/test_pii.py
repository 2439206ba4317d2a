"""Base spans against Python's re; the supervision on planted shapes; redaction."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from callweave.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d))))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    spans = [(m.start(), list(PLAIN).index(k), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def texts():
    rng = random.Random(4)
    out = [None, "", "a@b.c_d@e.f..g@h.i.j", ".@x.y", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "0000255.1.1.256 1.02.003.4", "+1 (555) 123-4567 and +12 34", "4111 1111 1111 1111, 4111-1111-1111-1112", "4111111111111111 4111111111111111", "é\U0001f600 x@y.zz é 10.0.0.1\U0001f600", "1" * 30000, "1 " * 20000, "a" * 60000 + "@", "+1" + "() " * 20000, "a@b" * 9000, "5 1.1.1.1" * 3000]
    alphabet = "0123456789" * 3 + "..--  @@++()abZ_%,\n"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 90))) for _ in range(600)]
    for _ in range(200):
        d = [rng.randrange(10) for _ in range(rng.randrange(12, 20))]
        d.append(-sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10)
        sep = rng.choice(["", " ", "-"])
        out.append("x " + "".join(str(x) + (sep if i % 4 == 3 else "") for i, x in enumerate(d)) + " y")
    return out


def test_base(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame([*rows, (None, "p@q.rs", "x"), (0, None, "x")], "doc_id long, text string, found string").repartition(4)
    found = pii.summary(docs).collect()
    assert len(found) == len(rows) + 2
    by = {r["doc_id"]: r for r in found}
    for i, text, _ in rows:
        want = base(text)
        kept = [s for s in want]
        assert by[i]["base_sha256"] == hashlib.sha256(listed(kept).encode()).hexdigest(), (text, want, by[i]["spans"])
        assert [by[i][f"n_{k}"] for k in PLAIN] == [sum(s[3] == k for s in kept) for k in PLAIN]
        assert set(listed(kept).split(",")) <= set(by[i]["spans"].split(",")) or not kept
    assert pii.summary(docs.where("false")).count() == 0
    assert "Python" not in pii.summary(docs)._jdf.queryExecution().toString()


def test_added_spans(spark):
    rng = random.Random(1)
    rows = [(i, f"mail me at user{i}@mail.example.com or call +1 (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} ok") for i in range(80)]
    rows += [(100 + i, f"you can call (555) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} now") for i in range(20)]
    rows += [(200 + i, f"write to someone{i} [at] example [dot] com today") for i in range(20)]
    rows += [(300 + i, f"version {i}.2.3 of part 123-456 cost 99.95 in 2024-01-{i + 1:02d} item{i}@x") for i in range(9)]
    found = {r["doc_id"]: r["spans"] for r in pii.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i].count(",") == 1 for i in range(80))
    assert all(found[100 + i] == "phone:13:27" for i in range(20))
    assert all(found[200 + i].startswith("email:9:") for i in range(20))
    assert all("phone" not in found[300 + i] and "ip" not in found[300 + i] for i in range(9))


def test_reliabilities():
    """Labelers of known quality are told apart."""
    rng = np.random.default_rng(0)
    good = np.array([0.95, 0.6, 0.8, 0.55])
    truth = rng.random(20000) < 0.4
    votes = np.where(rng.random((20000, 4)) < good, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, chance, share = pii.reliabilities([tuple(p) for p in patterns.tolist()], [0] * len(counts), counts.tolist())
    assert abs(share[0] - 0.4) < 0.05
    assert np.abs(chance[:, 1, 2] - good).max() < 0.06


def test_redact(spark):
    rows = [(1, "Ask a.b@c.de, +1 (555) 123-4567 or 10.1.2.3.", "en"), (2, "clean é", None), (3, None, "x"), (4, "", "x"), (5, "+1 1111 1111 1111@x.yy end", "x")]
    found = {r["doc_id"]: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[1]["text"] == "Ask <email>, <phone> or <ip>." and found[1]["lang"] == "en"
    assert [found[i]["text"] for i in (2, 3, 4)] == ["clean é", None, ""]
    assert "1111" not in found[5]["text"] and found[5]["text"].endswith(" end")


def redacted(text, spans):
    """A loop's version: spans as in pii.find."""
    merged = []
    for s in spans:
        if merged and merged[-1][1] > s["start"]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for start, end, kind in reversed(merged):
        text = text[:start] + f"<{kind}>" + text[end:]
    return text


def test_redact_as_a_loop(spark):
    rng = random.Random(8)
    more = ["".join(rng.choice(["é", "\U0001f600", "\n", "z ", "a@b.cd ", "+1 555 123 4567 ", "x" * 700 + " ", "10.0.0.1 ", "4111 1111 1111 1111"]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows = list(enumerate([t for t in texts() if t is not None] + more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = {r["row"]["doc_id"]: r["found"] for r in pii.find(docs).collect()}
    found = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert found == {i: redacted(t, spans[i]) for i, t in rows}


def test_more_spans_keep_off_base_spans(spark):
    """What the other shapes add overlaps no base span, and nothing else is left out by that."""
    rows = [(i, t) for i, t in enumerate(texts())] + [(5000, "+1 (555) 123-4567 (555) 123-4567 555-123-4567@x.yz 555-123-4567 a@b " * 300)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lone = {k: re.compile(p) for k, p in pii._MORE.items()}
    for r in found:
        own = [(s["start"], s["end"]) for s in r["found"] if s["base"]]
        added = {(s["kind"], s["start"], s["end"]) for s in r["found"] if not s["base"]}
        every = {(i, m.start(), m.end()) for i, k in enumerate(pii.KINDS) for m in lone[k].finditer(r["row"]["text"] or "")}
        assert added == {x for x in every if not any(s < x[2] and x[1] < e for s, e in own)}


def test_many_spans_take_linear_time(spark):
    """A text of 80,000 spans takes no more than some times as long as one of 20,000, both ways."""

    def took(n):
        docs = spark.createDataFrame([(1, "".join(f"u{i}@mail{i}.example.com (555) 123-4567 é " for i in range(n)))], "doc_id long, text string")
        began = time.monotonic()
        got = pii.summary(docs).first()
        text = pii.redact(docs).first()["text"]
        assert got["n_email"] == n and got["spans"].count("email:") == n
        assert text.count("<email>") == n and "@" not in text
        return time.monotonic() - began

    took(100)
    small, large = took(10_000), took(40_000)
    assert large < 8 * small + 2, (small, large)


@pytest.mark.parametrize("patterns", [[], [(0, 1, 1, 0, 1, 0, 5)]])
def test_few_patterns(patterns):
    assert np.isfinite(pii.span_classifier(patterns)).all()
