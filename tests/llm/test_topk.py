"""Exact top-k against brute force."""

import math

import numpy as np
import pytest

from callweave.llm import topk


def brute(rows, queries, k):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(x)) for x in v]

    made = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = []
    asked = {}
    for i, v in queries:
        if i is not None and whole(v) is not None:
            asked[i] = min(asked.get(i, whole(v)), whole(v))
    for i, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in made if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,part,head", [(topk.BLOCK_VALUES, topk.QUERY_SLICE, 2048), (12 * 7, 9, 3)])
def test_top_k(spark, block, part, head):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * rng.lognormal(sigma=1)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")]), (2004, [0.5] * 3), (2005, []), (None, [9.0] * 12), (3, rows[5][1]), (50, rows[50][1])]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(5)
    found = topk.top_k(docs, docs.where("vec_id % 10 = 0"), k=5, scale=256.0, block_values=block, query_slice=part, head_rows=head)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0], 5)


def test_few_and_huge(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none, scale=256.0).count() == 0
    few = spark.createDataFrame([(1, [1e17, 1.0]), (2, [1e17, 3.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    found = sorted(map(tuple, topk.top_k(few, few, scale=1.0).collect()))
    assert found == [(1, 1, 2, 2**63 - 1), (1, 2, 3, -(10**17)), (2, 1, 1, 2**63 - 1), (2, 2, 3, -(10**17)), (3, 1, 1, -(10**17)), (3, 2, 2, -(10**17))]
