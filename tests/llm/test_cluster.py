"""Centroid clustering against a plain version in Python's integers, and against its SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from scryline.llm import cluster
from tests.conftest import SMALL, same

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    distance = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    best = lambda v: min((distance(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(best(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else c for j, c in enumerate(centroids)]
    found = [(i, *best(v)) for i, v in kept]
    fits = lambda x: x if x < 1 << 63 else None
    sums = [sum(d for _, d, j in found if j == c) for c in range(len(centroids))]
    return [(i, j, fits(d), fits(sums[j]), fits(sum(sums)), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def vectors(scale, n=60, width=4, seed=0):
    rng = random.Random(seed)
    f = lambda x: float(np.float32(x))
    return [(i, [f(rng.gauss(i % 3, 0.3) * scale(i)) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("scale", [lambda i: 1, lambda i: 1e4, lambda i: 1e6, lambda i: 1e12, lambda i: 3e37, lambda i: 10.0 ** (i % 12 * 3), lambda i: 1e9 if i == 7 else 1])
def test_equals_plain_version(spark, scale):
    """Components of any size: in float64, in 64-bit integers and in Python's; and all of them in one table."""
    rows = vectors(scale)
    rows += [rows[0], rows[1], (None, rows[2][1]), (100, None), (101, [1.0]), (102, [1.0, None, 1.0, 1.0]), (103, [1.0, float("nan"), 1.0, 1.0]), (104, [float("-inf")] * 4), (3, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, ids int, x string").repartition(3)
    assert order(cluster.clustered(df, "vec_id", "embedding", k=5, rounds=4, width=4).select(*COLUMNS).collect()) == order(plain(rows, 5, 4, 4))


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(1, [0.5, -0.25]), (2, [0.5, -0.25])]
    assert order(cluster.clustered(spark.createDataFrame(few, schema), "vec_id", "embedding", width=2).collect()) == order(plain(few, 8, 10, 2))
    none = cluster.clustered(spark.createDataFrame([], schema), "vec_id", "embedding")
    assert none.columns == COLUMNS and none.count() == 0


def test_same_as_sql(spark, duck):
    same(cluster.op11_clustering(spark, SMALL), duck, cluster.OP11_SQL)


def test_bound_is_exact():
    """At the bound the matrix product gives what integers give."""
    rng = np.random.default_rng(1)
    top = cluster.bound(64) - 1
    x, c = rng.integers(-top, top + 1, (50, 64)), rng.integers(-top, top + 1, (8, 64))
    x[0], c[0] = top, -top
    best, found = cluster.nearest(x.astype(float), c.tolist())
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for v in x]
    assert list(zip(found.tolist(), best.tolist())) == want
