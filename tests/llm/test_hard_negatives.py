"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, k=5):
    good = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, y, [math.floor(256 * float(np.float32(x))) for x in v]))
    score = lambda p, q: sum(x * y for x, y in zip(p, q, strict=False))
    out = []
    for n, (i, y, v) in enumerate(good):
        if i % every:
            continue
        near = sorted((-score(v, u), j) for m, (j, z, u) in enumerate(good) if z == y and m != n)[:k]
        for s, p in near:
            hard = sorted((-score(v, u), j) for j, z, u in good if z != y and -80 * s <= 100 * score(v, u) <= -100 * s)[:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(hard)]
    return sorted(out)


def found(spark, rows, every=10, **more):
    lists = H.index(H.quantised(spark.createDataFrame(rows, SCHEMA)), lists=more.pop("lists", None))
    got = H.mine(lists, F.col("key") % every == 0, **more)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def clustered(n, seed, dim=8, labels=3, spread=0.1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    return [(k, (centre[k % 12] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize(("seed", "spread", "lists", "block"), [(1, 0.1, None, 6000), (2, 1.0, 40, 7), (3, 0.02, 64, 6000)])
def test_equals_brute_force(spark, seed, spread, lists, block):
    rows = clustered(400, seed, spread=spread)
    assert found(spark, rows, lists=lists, block=block) == brute(rows)


def test_odd_rows(spark):
    rows = clustered(60, 4) + [
        (None, [1.0] * 8, 1), (70, None, 1), (80, [1.0] * 8, None), (90, [1.0, None] + [0.0] * 6, 1), (100, [float("nan")] * 8, 1), (110, [float("inf")] * 8, 1),
        (120, [], 0), (130, [0.0] * 8, 0), (140, [0.5] * 3, 1), (0, [0.25] * 8, 1), (0, [0.25] * 8, 1), (-10, [2000.0] * 8, 2), (-20, [-2000.0] * 8, 2), (-30, [1e6] * 8, 0),
    ]
    assert found(spark, rows) == brute(rows)


def test_equal_rows(spark):
    rows = [(k, [0.5, -0.25], k % 2) for k in range(3000)]
    got = found(spark, rows, every=1000)
    assert got == brute(rows, every=1000) and len(got) == 3 * 25


def test_far_lists_are_not_visited(spark, monkeypatch):
    rows = clustered(600, 5, spread=0.01)
    seen = []
    scan = H._scan
    monkeypatch.setattr(H, "_scan", lambda lists, sent, wanted, dtype: (seen.append(wanted.value.mean()), scan(lists, sent, wanted, dtype))[1])
    monkeypatch.setattr(H, "FIRST", 2)
    assert found(spark, rows, lists=36) == brute(rows)
    assert sum(seen) < 1.2  # of 2, if both searches visited all lists


def test_empty_and_too_large(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []
    with pytest.raises(Exception, match="32 bits"):
        found(spark, [(0, [1e9], 1), (10, [1.0], 1)])
