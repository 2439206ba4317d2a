"""Exact dedup and SimHash groups against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave.llm import bitslice, common, components, dedup, simhash

ROWS = [(1, "a b c", "x"), (2, "a b c", "y"), (2, "a b c", "y"), (3, "", None), (4, None, "z"), (None, "a b c", "q"), (None, "only", "q"), (7, "other " * 5000, None), (9, "a b d", "")]
SCHEMA = "doc_id long, text string, hash string"  # a column whose name the operator uses itself


def expected(rows, best):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[t or ""]
        keep = best([x for x in own if x is not None], default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hash_of", [F.md5, lambda c: F.length(c)], ids=["md5", "colliding"])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(spark, keep, hash_of):
    found = dedup.exact_groups(spark.createDataFrame(ROWS, SCHEMA), keep, hash_of=hash_of)
    assert sorted(map(tuple, found.collect()), key=repr) == expected(ROWS, {"largest": max, "smallest": min}[keep])


def test_exact_empty(spark):
    assert dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spark_hash_is_xxh64(spark):
    for text in ("", "a", "abc def ghi", "é" * 50):
        assert spark.sql("select xxhash64(:t)", {"t": text}).first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def plain_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÄ \t\n x.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def test_close_pairs():
    rng = np.random.default_rng(1)
    for n, radius in ((1, 2), (70, 2), (300, 2), (130, 0), (90, 5)):
        fps = rng.integers(0, 2**63, max(1, n // 6), dtype=np.uint64)[rng.integers(0, max(1, n // 6), n)]
        for _ in range(radius + 1):
            fps ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) * rng.integers(0, 2, n).astype(np.uint64)
        run = np.sort(rng.integers(0, 3, n))
        left, right = bitslice.close_pairs(fps, run, radius, block_words=1)
        want = {(i, j) for i in range(n) for j in range(i + 1, n) if run[i] == run[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius}
        assert set(zip(left.tolist(), right.tolist())) == want


def components_of(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    want = components_of(300, pairs)
    found = dict(map(tuple, components.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()))
    assert found == {i: want[i] for p in pairs[:-1] for i in p}


@pytest.mark.parametrize("at_once", [1 << 18, 50])
def test_components_over_many_tasks(spark, at_once, monkeypatch):
    """Chains, stars and cycles whose links lie in many tasks, which take more than one round."""
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(4)
    order = rng.sample(range(400), 400)
    pairs = [*zip(order, order[1:])] + [(450, j) for j in range(451, 700)] + [(j, 699) for j in range(700, 900)] + [(rng.randrange(900, 1100), rng.randrange(900, 1100)) for _ in range(120)]
    want = components_of(1100, pairs)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "13"), strict=True):
        spark.conf.set(k, v)
    try:
        rounds, least = [], components._least
        monkeypatch.setattr(components, "_least", lambda links: rounds.append(1) or least(links))
        rows = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert dict(map(tuple, rows)) == {i: want[i] for p in pairs if p[0] != p[1] for i in p} and len(rounds) > 1
    assert len(rows) == len({r[0] for r in rows})


def test_stars_take_no_round(spark, monkeypatch):
    """Links that are stars already need one grouping and no join: each table and job of a round is planned on the driver."""
    made = []
    monkeypatch.setattr(components, "written", lambda df, name, keep=False: made.append(name) or common.written(df, name, keep))
    rows = components.components(spark.createDataFrame([(5, j) for j in range(6, 90)] + [(1, 3)], "a long, b long")).collect()
    assert dict(map(tuple, rows)) == {1: 1, 3: 1, **{j: 5 for j in range(5, 90)}}
    assert made == ["links", "least", "components"]
    made.clear()
    assert not components.components(spark.createDataFrame([(5, 5), (None, 3)], "a long, b long")).collect()


@pytest.mark.parametrize("most", [1024, 3])
def test_near_groups(spark, most):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(60):
        words = base[(i % 6) * 50 : (i % 6) * 50 + 200]
        for _ in range(i % 5):
            words = [*words]
            words[rng.randrange(len(words))] = "changed"
        rows.append((i * 3 % 61, " ".join(words)))
    rows += [(100, ""), (101, None), (102, "One"), (103, "one"), (103, "one"), (None, "one"), (104, "x " * 40000)]
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()
    fps = [plain_fingerprint(t or "") for _, t in rows]
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    pairs = [(a, b) for a in known for b in known if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    of = components_of(len(rows), pairs)
    least = {}
    for k in known:
        least[of[k]] = min(least.get(of[k], 10**9), rows[k][0])
    want = [(i, f"{fps[k]:016x}", least[of[k]] if i is not None else 102) for k, (i, _) in enumerate(rows)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert len(set(of)) < 60


def test_near_groups_of_repeated_ids(spark):
    """An id with two unlike texts doesn't join what is near to each of them."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    a, b = " ".join(words), " ".join(words[::-1])
    near = next(t for t in (" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in range(600)) if 0 < bin(plain_fingerprint(t) ^ plain_fingerprint(a)).count("1") <= 2)
    assert bin(plain_fingerprint(a) ^ plain_fingerprint(b)).count("1") > 6
    rows = [(1, a), (1, b), (0, near), (7, b), (7, a), (7, a)]
    found = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, f"{plain_fingerprint(t):016x}", 1 if t == b else 0) for i, t in rows]
    assert sorted(map(tuple, found)) == sorted(want)


def test_similar_groups(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, group = [], []
    for g in range(12):
        words = [word() for _ in range(150)]
        for _ in range(1 if g % 3 else 8):
            own = list(words)
            for at in rng.sample(range(150), rng.randrange(2)):
                own[at] = word()
            group.append(g)
            rows.append((len(rows) * 5 % 997, " ".join(own)))
    rows += [(900, ""), (901, None), (None, rows[0][1]), (902, "one two"), (903, "ONE two"), (904, "x y z " * 20000)]
    group += [100, 100, 0, 101, 101, 102]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, 10**9), i)
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r[0], r[1]) for r in found), key=repr) == sorted(((i, least[g]) for (i, _), g in zip(rows, group, strict=True)), key=repr)
    assert simhash.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard_groups(rows, size=5, similarity=0.8):
    """(id, the smallest id that links of this similarity reach), by brute force."""
    words = [t.lower().split() for _, t in rows]
    sets = [{" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in words]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    of = components_of(len(rows), pairs)
    least = {}
    for (i, _), g in zip(rows, of, strict=True):
        least[g] = min(least.get(g, 10**9), i)
    return sorted((i, least[g]) for (i, _), g in zip(rows, of, strict=True)), len(pairs)


def test_similar_groups_jaccard(spark):
    """Only pairs of similarity 0.8 and more are linked."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for n in range(60):
        words = [word() for _ in range(200)]
        changed = list(words)
        for at in range(3 + n % 7):  # 5 of 196 shingles each: similarity 0.86 to 0.63
            changed[10 + 20 * at] = word()
        short = [word() for _ in range(8)]
        texts += [words, changed, short, [*short, word()]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want, links = jaccard_groups(rows)
    assert 60 < links < 110
    found = sorted((r[0], r[1]) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    of = dict(want)
    assert all(of[i] == of[component] for i, component in found) and sum(i != component for i, component in found) > links / 2
    assert found == want  # a band misses one pair in a thousand at most


def test_band_keys():
    """Pairs of similarity 0.8 share a key, and keys don't depend on other documents."""
    rng = np.random.default_rng(6)
    tables = simhash.bands(0.8)
    assert (1 - 0.8**simhash.BAND) ** tables <= 0.001
    missed = 0
    for n in range(1500):
        both, own = rng.integers(0, 2**63, 4 * (1 + n % 20), np.uint64), rng.integers(0, 2**63, 1 + n % 20, np.uint64)
        missed += not (simhash.band_keys(np.sort(both), tables) == simhash.band_keys(np.sort(np.concatenate([both, own])), tables)).any()
    assert missed <= 6


def test_similar_groups_hot(spark, monkeypatch):
    """Keys of many rows give the groups of all pairs, and no task compares a whole key."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(120)], []
    for n in range(140):
        own = list(base)
        for at in rng.sample(range(120), n % 7):
            own[at] = word()
        rows.append((n * 7 % 997, " ".join(own)))
    want, _ = jaccard_groups(rows)
    assert 1 < len({g for _, g in want}) < 100
    seen, plain = [], simhash.hot_links
    monkeypatch.setattr(simhash, "hot_links", lambda hot, *a: (seen.append(hot.groupBy("key").count().agg(F.max("count")).first()[0]), plain(hot, *a, rounds=1, part=16))[1])
    found = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=8)
    assert sorted((r[0], r[1]) for r in found.collect()) == want and seen[0] > 30
