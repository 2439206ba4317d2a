"""Lloyd rounds over cover trees and kd-trees against loops."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from callweave.llm.clustering import CoverTree, assigned, lloyd
from callweave.llm.codes import KdTrees, codes, filtered


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(v, centers):
    far = [distance(v, c) for c in centers]
    return far.index(min(far)), min(far)


def moved(vectors, centers):
    of = defaultdict(list)
    for v in vectors:
        of[nearest(v, centers)[0]].append(v)
    return [[sum(x) // len(of[i]) for x in zip(*of[i], strict=True)] if of[i] else c for i, c in enumerate(centers)]


@pytest.mark.parametrize("trial", range(20))
def test_trees(trial):
    rng = np.random.default_rng(trial)
    n, width, k, parts = (int(rng.integers(1, m)) for m in (150, 6, 25, 4))
    most = [2, 5, 60, 900, 2**40][trial % 5]
    points, centers = rng.integers(-most, most + 1, (n, width)), rng.integers(-most, most + 1, (k, width))
    cut, books = rng.integers(-most, most + 1, (n, parts, width)), rng.integers(-most, most + 1, (parts, k, width))
    if trial % 3 == 0:
        points[: n // 2], cut[: n // 2] = points[0], cut[0]
    if trial % 4 == 0:
        centers[: k // 2], books[:, : k // 2] = centers[0], books[:, :1]
    tree = CoverTree(points, leaf=1 + trial % 8)
    assert sorted(map(tuple, tree.points.tolist())) == sorted(map(tuple, points.tolist())) and (points[tree.order] == tree.points).all()
    assert [nearest(p, centers.tolist())[0] for p in tree.points.tolist()] == assigned(tree, CoverTree(centers, leaf=1)).tolist()
    trees = KdTrees(cut, leaf=1 + trial % 8)
    own, sums, counts = filtered(trees, books)
    found = np.zeros((parts, n), np.int64)
    found.reshape(-1)[trees.order] = own
    for j in range(parts):
        want = [nearest(p, books[j].tolist())[0] for p in cut[:, j].tolist()]
        assert want == found[j].tolist()
        for e in range(k):
            assert counts[j, e] == want.count(e)
            assert [int(x) for x in sums[j, e]] == [sum(x) for x in zip([0] * width, *(p for p, w in zip(cut[:, j].tolist(), want, strict=True) if w == e), strict=True)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string, error string").repartition(3)


def some_rows(seed, n, size):
    """Vectors with copies, ties, repeated and missing ids, and others that take no part."""
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.random() - 0.5, 0.25, -0.25]) for _ in range(size)], rng.choice([None, 1, 2]), "a", "b") for i in range(n)]
    rows += [(n + i, rows[3][1], 7, None, None) for i in range(n)] + [(5, rows[8][1], 1, "", "")] * 2 + [(None, rows[9][1], 2, "", "")]
    return rows, [(9000, None, 1, "", ""), (9001, [0.5, None] * (size // 2), 1, "", ""), (9002, [float("nan")] * size, 1, "", ""), (9003, [float("inf")] + [0.0] * (size - 1), 1, "", ""), (9004, [], 1, "", ""), (9005, [0.5] * (size + 4), 1, "", "")]


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("rounds", [0, 3])
def test_lloyd(spark, rounds):
    rows, others = some_rows(rounds, 60, 4)
    found = lloyd(table(spark, rows + others), k=7, rounds=rounds, seed=2, size=4, scale=256.0, block_rows=16).collect()
    kept = [(i, whole(v)) for i, v, *_ in rows]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in order[:7]]
    for _ in range(rounds):
        centers = moved([v for _, v in kept], centers)
    want = [(i, *nearest(v, centers)) for i, v in kept]
    own = defaultdict(int)
    for _, c, d in want:
        own[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    want = [(i, c, d, own[c], sum(own.values()), digest[c]) for i, c, d in want]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_lloyd_of_few_and_none(spark):
    rows, others = some_rows(1, 10, 4)
    assert {r.cluster for r in lloyd(table(spark, rows[:2]), 40, 2, 2, 4, 256.0).collect()} == {0, 1}
    assert lloyd(table(spark, others), 40, 2, 2, 4, 256.0).collect() == []
    assert lloyd(table(spark, []), 40, 2, 2, 4, 256.0).collect() == []


@pytest.mark.parametrize("rounds", [0, 2])
def test_codes(spark, rounds):
    rows, others = some_rows(10 + rounds, 50, 8)
    found = codes(table(spark, rows + others), parts=4, entries=9, rounds=rounds, scale=256.0, block_rows=32).collect()
    kept = [(i, whole(v), label) for i, v, label, *_ in rows]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:9]
    cut = lambda v, j: v[2 * j : 2 * j + 2]
    books = [[cut(v, j) for _, v in first] for j in range(4)]
    for _ in range(rounds):
        books = [moved([cut(v, j) for _, v, _ in kept], books[j]) for j in range(4)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want, own = [], defaultdict(int)
    for i, v, label in kept:
        best = [nearest(cut(v, j), books[j]) for j in range(4)]
        want.append((i, "".join(f"{e:02x}" for e, _ in best), sum(d for _, d in best), label))
        own[label] += want[-1][2]
    assert sorted(map(tuple, found), key=repr) == sorted(((i, c, e, own[x], digest) for i, c, e, x in want), key=repr)


def test_codes_of_few_and_none(spark):
    rows, others = some_rows(1, 10, 8)
    assert {r.error for r in codes(table(spark, rows[:2]), parts=4, rounds=1).collect()} == {0}
    assert codes(table(spark, []), parts=4).collect() == []
    assert codes(table(spark, others[:4]), parts=4).collect() == []
    with pytest.raises(ValueError):
        codes(table(spark, rows), parts=3)
    with pytest.raises(ValueError):
        codes(table(spark, rows), entries=257)
