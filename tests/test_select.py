"""Greedy selections against plain walks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.operators import select

ROWS = "id long, pool string, rank long, shape string, maker string, _pool string"


def turns(rows, n, cap):
    """One pool after the other, row by row."""
    pools = {p: sorted(r for r in rows if r[1] == p) for p in sorted({r[1] for r in rows})}
    for own in pools.values():
        own.sort(key=lambda r: (r[2], r[0]))
    most = max(1, -(-2 * n // max(1, len(pools))))
    at, taken, shapes, makers, out = Counter(), Counter(), set(), Counter(), []
    while len(out) < n:
        took = False
        for p, own in pools.items():
            while taken[p] < most and at[p] < len(own) and len(out) < n:
                r = own[at[p]]
                at[p] += 1
                if r[3] in shapes or (r[4] != "Unknown artist" and makers[r[4]] >= cap):
                    continue
                shapes.add(r[3])
                makers[r[4]] += 1
                taken[p] += 1
                out.append((r[0], p, taken[p]))
                took = True
                break
        if not took:
            break
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_pools_that_share_rows(spark, seed):
    rng = random.Random(seed)
    kinds = rng.choice([15, 80])
    things = [(i, f"s{i % kinds}", "Unknown artist" if i % kinds % 5 == 0 else f"m{i % kinds % rng.choice([7, 7])}") for i in range(160)]
    rows = [(i, p, rng.randrange(40), s, m, "x") for i, s, m in things for p in "abcde" if rng.random() < 0.5]
    n, cap = rng.choice([12, 40]), rng.choice([1, 3])
    df = spark.createDataFrame(rows, ROWS)
    for few in (0, select.FEW):
        got = select.round_robin(df.drop("_pool"), "pool", [F.col("rank"), F.col("id")], n, "shape", "maker", cap, few=few)
        assert sorted((r.id, r.pool, r.turn) for r in got.collect()) == turns(rows, n, cap)


def test_no_pools(spark):
    assert select.round_robin(spark.createDataFrame([], ROWS).drop("_pool"), "pool", [F.col("rank")], 5, "shape", "maker", 1).count() == 0


def greedy(rows, limit):
    a, b, out = Counter(), Counter(), []
    for i, x, y in sorted(rows):
        if a[x] < limit and b[y] < limit:
            a[x] += 1
            b[y] += 1
            out.append(i)
    return out


@pytest.mark.parametrize("few", [0, 40, select.FEW])
def test_chained_keys_are_walked(spark, few):
    """A chain decides one row after the other; the last ones in one task."""
    chain = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(14)]
    rng = random.Random(3)
    rows = chain + [(100 + i, f"x{rng.randrange(6)}", f"y{rng.randrange(9)}") for i in range(60)]
    got = select.two_key_cap(spark.createDataFrame(rows, "i long, a string, b string"), "a", "b", ["i"], 1, few=few)
    assert sorted(r.i for r in got.collect()) == greedy(rows, 1)
