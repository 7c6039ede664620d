"""Screened clustering against plain rounds, and its bounds against exact distances."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from quillspan.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, v string, n long"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def brute(data, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in np.float32(e).astype(float)]) for i, e, *_ in data if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in start]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for _ in range(rounds):
        own = [min(range(len(c)), key=lambda j: (d(v, c[j]), j)) for _, v in kept]
        for j in range(len(c)):
            members = [v for (_, v), a in zip(kept, own, strict=True) if a == j]
            if members:
                c[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [min((d(v, c[j]), j) for j in range(len(c))) for _, v in kept]
    per = {j: sum(x for x, a in last if a == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted([(i, j, x, per[j], sum(per.values()), sha[j]) for (i, _), (x, j) in zip(kept, last, strict=True)], key=repr)


@pytest.fixture(scope="module")
def edges():
    rng = np.random.default_rng(3)
    around = rng.normal(size=(6, 64))
    data = [(i, (around[i % 6] + rng.normal(size=64) * 0.1).tolist(), 1, 2, "x", 3) for i in range(150)]
    data += [(200, None, 1, 1, "x", 1), (201, [], 1, 1, "x", 1), (202, [1.0] * 63, 1, 1, "x", 1), (203, [None, *[1.0] * 63], 1, 1, "x", 1)]
    data += [(204, [math.nan, *[1.0] * 63], 1, 1, "x", 1), (205, [math.inf, *[0.0] * 63], None, None, None, None), (206, [0.0] * 64, 1, 1, "x", 1)]
    data += [(207, [-0.001] * 64, 1, 1, "x", 1), (208, [1000.0, *[0.0] * 63], 1, 1, "x", 1), (None, around[0].tolist(), 1, 1, "x", 1), data[3], data[3], (3, around[2].tolist(), 1, 1, "x", 1)]
    return data


@pytest.mark.parametrize("k,rounds", [(7, 5), (40, 2)])
def test_clusters_equal_plain_rounds(spark, edges, k, rounds):
    got = rows(centroids.cluster(spark.createDataFrame(edges, SCHEMA), k, rounds))
    assert got == brute(edges, k, rounds)


def test_clusters_equal_sql(spark, edges):
    embeddings = spark.createDataFrame(edges, SCHEMA).toArrow()  # noqa: F841
    want = duckdb.connect().sql(f"SELECT {', '.join(COLUMNS)} FROM ({centroids.SQL})").fetchall()
    assert rows(centroids.cluster(spark.createDataFrame(edges, SCHEMA))) == sorted(want, key=repr)


def test_few_or_no_vectors(spark, edges):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame(edges[150:153], SCHEMA)).columns == COLUMNS
    one = centroids.cluster(spark.createDataFrame(edges[:1], SCHEMA)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in one] == [(0, 0, 0)]


def test_huge_components_are_bounded(spark):
    data = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got = {r.vec_id: r for r in centroids.cluster(spark.createDataFrame(data, "vec_id long, embedding array<float>"), 1, 0).collect()}
    assert max(r.distance for r in got.values()) <= 64 * (2**28) ** 2 and all(r.distance >= 0 for r in got.values())


def test_bounds_hold_and_screen():
    """Bounds never exceed the distance, also for vectors that are nearly equal; where vectors
    lie in clusters, few centroids get an exact distance."""
    rng = np.random.default_rng(7)
    for x in (rng.integers(-300, 300, (400, 64)), rng.integers(-(2**27), 2**27, (400, 64)), np.repeat(rng.integers(-9, 9, (20, 64)), 20, axis=0) * 1_000_003):
        c = np.concatenate([x[:30] + rng.integers(-1, 2, (30, 64)), x[5:6], x[5:6]])
        exact = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (centroids.bounds(centroids.compress(x), centroids.compress(c), 8) <= exact).all()
        at, best, _ = centroids.nearest(x, centroids.compress(x), c)
        assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()
    base = rng.integers(-2000, 2000, (40, 8)).repeat(8, axis=1)
    x = base[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64))
    at, _, exact = centroids.nearest(x, centroids.compress(x), base)
    assert (at == ((x[:, None] - base[None]) ** 2).sum(2).argmin(1)).all() and exact < 0.05 * 3000 * 40


def test_first_rows_decide_nothing(spark, edges):
    """The same rows in another order and partitioning."""
    df = spark.createDataFrame(edges, SCHEMA)
    assert rows(centroids.cluster(df.orderBy("embedding").repartition(9))) == rows(centroids.cluster(df.coalesce(1)))
