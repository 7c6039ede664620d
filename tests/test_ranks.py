"""Ranks by group, exact tests, shortlists and one-piece words against plain rules."""

import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from quillspan.functions.text import plain_words  # noqa: F401
from quillspan.operators import audit, metrics, names, search


def test_auc_with_one_group_that_has_nearly_all_rows(spark):
    rng = random.Random(1)
    rows = [("big", rng.random() < 0.3, float(rng.randrange(40))) for _ in range(3000)] + [(g, f, s) for g in ("a", "b", None) for f, s in ((True, 2.0), (False, 2.0), (False, 1.0))]
    df = spark.createDataFrame(rows + [("one", True, 1.0)], "grp string, fit boolean, score double")
    got = metrics.within_auc(df.repartition(7), "grp", "fit", "score")
    right = pairs = 0.0
    for g in {r[0] for r in rows}:
        fits, others = ([s for k, f, s in rows if k == g and f is side] for side in (True, False))
        right += sum((x > y) + 0.5 * (x == y) for x in fits for y in others)
        pairs += len(fits) * len(others)
    assert abs(got.first().auc - right / pairs) < 1e-12
    windows = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert all("_range" in line for line in windows)  # none has a whole group


def test_ranks_within_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(12)) for _ in range(400)]
    got = {(r.g, r.v): r.rank for r in metrics.shared_ranks(spark.createDataFrame(rows, "g string, v int"), "v", "rank", ("g",)).collect()}
    for g in "ab":
        own = sorted(v for k, v in rows if k == g)
        for v in set(own):
            assert got[g, v] == np.mean([i + 1 for i, x in enumerate(own) if x == v])


def exact(n, m, a, b):
    t = a + b
    return Fraction(sum(math.comb(n, k) * math.comb(m, t - k) for k in range(a, min(n, t) + 1) if t - k <= m), math.comb(n + m, t))


def chance(rows):
    n, m, a, b = (pd.Series(x, dtype="int64") for x in zip(*rows, strict=True))
    return audit.rise_by_chance.func(n, m, a, b).tolist()


def test_tail_equals_exact_fractions():
    rng = random.Random(3)
    rows = [(n := rng.randint(0, 60), m := rng.randint(0, 60), rng.randint(0, n), rng.randint(0, m)) for _ in range(400)]
    rows += [(300, 5000, 40, 200), (2000, 3000, 1100, 1200), (1, 1, 1, 0), (5, 0, 5, 0), (0, 5, 0, 5), (5, 5, 0, 0)]
    for row, p in zip(rows, chance(rows), strict=True):
        assert p == pytest.approx(float(exact(*row)), rel=1e-9)


def test_tail_of_a_hundred_million_texts():
    rows = [(10**8, 10**8, 25, 5), (10**8, 3 * 10**7, 40, 1), (10**6, 10**8, 6, 20)]
    for row, p in zip(rows, chance(rows), strict=True):
        assert p == pytest.approx(float(exact(*row)), rel=1e-9)
    wide = chance([(10**8, 10**8, 50_010_000, 50_000_000), (10**8, 10**8, 50_000_000, 50_000_000)])
    assert 0.02 < wide[0] < 0.2 and 0.5 <= wide[1] < 0.5001


@pytest.mark.parametrize("size", [2, 16])
def test_wins_from_shortlists(spark, size):
    """Lists that are too short for the penalties are seen, and their queries are searched again."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 8))
    items = [(i, i % 3, i % 5, float(rng.random() * 0.6 * (i % 2)), (base[i % 3] + 0.4 * rng.normal(size=8)).tolist()) for i in range(120)]
    df = spark.createDataFrame(items, "id long, category int, creator long, penalty double, vector array<double>")
    queries = df.where("id % 4 = 0").selectExpr("id AS qid", "creator AS qcreator", "vector AS qvector")
    short = search.shortlists(df, queries, size)
    got, anew = search.wins_of(short, df, queries)
    want = {r.id: r.wins for r in search.wins(df, queries).collect()}
    assert {r.id: r.wins for r in got.collect()} == want
    assert (anew.count() > 0) == (size == 2)


def test_one_piece_words(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    asked = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.word for r in names.one_piece_words(spark).collect()}
    one = lambda w: len(asked.encode(w, add_special_tokens=False).ids) == 1
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(1, 4))) for _ in range(4000)}
    words |= {"love", "film", "quillspan", "mountain", "2000", "zzyzx", *(w[: rng.randint(1, len(w))] for w in sorted(got)[:2000])}
    assert {w for w in words if one(w)} == words & got and len(got) > 10_000


@pytest.mark.parametrize("room", [search.QUERY_BYTES, 1500])
def test_a_callers_rule(spark, room, monkeypatch):
    """In one broadcast block, and in pairs of blocks."""
    monkeypatch.setattr(search, "QUERY_BYTES", room)
    rng = np.random.default_rng(8)
    items = [(i, i % 2, i % 7, rng.normal(size=6).tolist(), 0.0, 1990 + i % 20, "ab"[i % 3 == 0]) for i in range(90)]
    df = spark.createDataFrame(items, "id long, category int, creator long, vector array<double>, penalty double, year int, kind string")
    queries = df.where("id % 6 = 0").selectExpr("id AS qid", "creator AS qcreator", "vector AS qvector", "year AS qyear")
    rule = search.Rule(lambda q, i: (abs(q["qyear"][:, None] - i["year"]) > 4) | (i["kind"] == "b"), ("qyear",), ("year", "kind"))
    got = {(r.qid, r.category, r.place): r.id for r in search.nearest(df, queries, 2, rule=rule).collect()}
    want = {}
    for q in items[::6]:
        for c in (0, 1):
            best = {}
            for i in items:
                if i[1] == c and abs(q[5] - i[5]) <= 4 and i[6] != "b":
                    key = (-round(float(np.dot(q[3], i[3])), 6), i[0])
                    best[i[2]] = min(best.get(i[2], key), key)
            for place, (_, i) in enumerate(sorted(best.values())[:2], 1):
                want[q[0], c, place] = i
    assert got == want
