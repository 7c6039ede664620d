"""Search, names and orders against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import hashing, vectors
from quillspan.operators import names, search, space

ITEMS = "id long, category int, creator long, title string, vector array<float>, penalty double"


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), int(rng.integers(12)), f"t{rng.integers(30)}", np.round(rng.normal(size=8), 1).astype(np.float32).tolist(), float(rng.integers(3)) / 10) for i in range(150)]
    return spark.createDataFrame(rows, ITEMS), rows


def best(rows, q, same, other, own, per_creator=True):
    """The sequential rule: sort, then walk and skip."""
    qid, qcat, qcreator, qtitle, qv, gone = q
    out = []
    for cat in sorted({r[1] for r in rows}):
        scored = sorted(((-round(float(np.dot(np.array(qv, float), np.array(r[4], float)) - r[5]), 6), r[0], r) for r in rows if r[1] == cat and not (own and (r[0] == qid or r[2] == qcreator or r[3] == qtitle)) and r[0] not in gone))
        seen, n = set(), 0
        for s, i, r in scored:
            if n < (same if cat == qcat else other) and not (per_creator and r[2] in seen):
                seen.add(r[2])
                n += 1
                out.append((qid, cat, i, -s, n))
    return out


@pytest.mark.parametrize("same,other,own,per_creator", [(2, 2, True, True), (3, 1, True, True), (0, 2, False, True), (4, 4, False, False)])
@pytest.mark.parametrize("blocks", [False, True])
def test_nearest_equals_the_walk(spark, items, monkeypatch, same, other, own, per_creator, blocks):
    df, rows = items
    if blocks:  # many blocks of queries and of items, and small score matrices
        monkeypatch.setattr(search, "QUERY_BYTES", 400)
        monkeypatch.setattr(search, "ITEM_ROWS", 40)
        monkeypatch.setattr(search, "CELLS", 300)
    asked = [(r[0], r[1], r[2], r[3], r[4], [r[0] + 1, r[0] + 2] if r[0] % 2 else []) for r in rows[::10]]
    queries = spark.createDataFrame(asked, "qid long, qcategory int, qcreator long, qtitle string, qvector array<float>, qexclude array<long>")
    got = sorted(map(tuple, search.nearest(df, queries, same, per_creator, own, other).collect()))
    assert got == sorted(x for q in asked for x in best(rows, q, same, other, own, per_creator))


def test_no_queries_or_items(spark, items):
    df, _ = items
    none = spark.createDataFrame([], "qid long, qcreator long, qvector array<float>")
    one = spark.createDataFrame([(1, 1, [1.0] * 8)], "qid long, qcreator long, qvector array<float>")
    assert search.nearest(df, none, 2).count() == 0 and search.nearest(df.limit(0), one, 2).count() == 0


def test_exposure_equals_the_plain_rounds(spark, items):
    df, rows = items
    df = df.withColumn("penalty", F.lit(0.0))
    queries = df.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("creator").alias("qcreator"), F.col("vector").alias("qvector"))
    got = {r.id: r.penalty for r in search.exposure(df, queries).collect()}
    v, cat, p = np.array([r[4] for r in rows], float), np.array([r[1] for r in rows]), np.zeros(len(rows))
    for _ in range(6):
        s, wins = np.round(v[::3] @ v.T - p, 6), np.zeros(len(rows))
        for c in range(3):
            at = np.flatnonzero(cat == c)
            for row in s[:, at]:
                wins[at[np.lexsort((at, -row))[:2]]] += 1
        step = np.zeros(len(rows))
        for c in range(3):
            at = cat == c
            step[at] = 0.02 * np.log(np.maximum((wins[at] + 1) / (wins[at].mean() + 1), 1))
        p = np.round(0.5 * p + 0.5 * step, 8)
    assert np.allclose([got[i] for i in range(len(rows))], p.astype(np.float16).astype(float), atol=0)


def test_half_precision_equals_numpy(spark):
    x = [0.0, 1.0, -2.5, 1e-9, 6e-8, 1 / 3, 1000.3, 65504.0, -0.1, 2049.0, 2051.0]
    got = spark.createDataFrame([(float(v),) for v in x], "x double").select(vectors.half(F.col("x")).alias("h")).collect()
    assert [r.h for r in got] == np.array(x).astype(np.float16).astype(float).tolist()


def test_seeded_places():
    assert hashing._places(0, "x") == [] and hashing._places(1, "") == [0]
    for n in (2, 7, 50):
        assert sorted(hashing._places(n, f"seed {n} 𝄞")) == list(range(n))
    assert hashing._places(10, "a") == hashing._places(10, "a") != hashing._places(10, "b")


def test_farther_than_in_blocks(spark, items, monkeypatch):
    df, rows = items
    unit = df.withColumn("vector", vectors.unit(F.col("vector")))
    v = np.array([r[4] for r in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: round(float((u[i] @ u[::7].T).max()), 6) for i in range(150) if i % 7}
    for size in (1 << 20, 200):
        monkeypatch.setattr(space, "EVAL_BYTES", size)
        got = {r.id: r.nearest for r in space.farther_than(unit.where("id % 7 <> 0"), unit.where("id % 7 = 0"), 0.9).collect()}
        assert got == {i: x for i, x in want.items() if x < 0.9}


def test_item_space_keeps_products(spark, items):
    df, rows = items
    v = np.array([r[4] for r in rows], float)
    top = np.linalg.svd(v, full_matrices=False)[2][:5].T
    want = v @ top
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r.id: np.array(r.vector) for r in space.project(df, 5).collect()}
    mine = np.array([got[i] for i in range(150)])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-6)


def test_names_in_typed_texts(spark):
    rows = [(1, "song", "Angry", "The Band", "Angry Songs"), (2, "film", "Rain", "Someone", None), (3, "film", "Blade Runner", "Ridley Scott", None), (4, "song", "Essex Honey", "Blood Orange", "Essex Honey"),
            (5, "song", "Charm", "Blood Orange", "Essex Honey"), (6, "book", "Blade Runner", "Philip Dick", None), (7, "art", "The Night", "Night", None)]
    vec = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 1.0], 4: [1.0, 0.2], 5: [3.0, 1.0], 6: [0.5, 0.5], 7: [0.1, 0.9]}
    items = spark.createDataFrame([(*r, vec[r[0]]) for r in rows], "id long, category string, title string, creator string, album string, vector array<double>")
    texts = ["angry and i don't know why", "rain", "blade runner", "blade runner movie", "Essex Honey by Blood Orange", "blood orange", "the essex honey album", "blade runner by philip dick", "", None, "the", "Ridley  Scott's", "rain by someone", "night"]
    queries = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    common = ["angry", "rain", "know", "why", "night"]
    got = {r.qid: (r.kind, r.id) for r in names.name_matches(queries, items, common).collect()}
    assert got == {2: (0, 3), 3: (0, 3), 4: (0, 4), 5: (2, 4), 6: (0, 4), 7: (0, 6), 12: (0, 2), 13: (0, 7)}  # 13: title and creator are two names, though one word
    chosen = {r.qid: r.id for r in names.anchors(queries, items, common).collect()}
    assert chosen[5] == 5 and chosen[4] == 4  # the creator's items are represented by the one nearest to their sum
    assert names.name_matches(queries, items.limit(0), common).count() == 0


def test_common_and_name_words(spark):
    texts = spark.createDataFrame([("a b",), ("a c",), ("a a",), ("d",)], "t string")
    words = names.common_words(texts, "t", 0.5)
    assert [r.word for r in words.collect()] == ["a"]
    items = spark.createDataFrame([("A Thing", "x", None)], "title string, creator string, album string")
    assert [r.word for r in names.name_words(items, words).collect()] == ["a"]


def test_softmax_and_choice(spark):
    rng = random.Random(1)
    z = [rng.uniform(-3, 3) for _ in range(6)]
    row = spark.range(1).select(vectors.softmax(F.array(*map(F.lit, z)), 0.5).alias("s"), vectors.first_largest(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("i")).first()
    e = np.exp(np.array(z) / 0.5)
    assert np.allclose(row.s, e / e.sum()) and row.i == 1


def test_every_query_meets_every_item_of_the_step(spark):
    from quillspan.plans import wall

    rows = wall.candidate_sample(spark, "/root/testdata/sf0.001").collect()
    queries, items = {r.qid for r in rows}, {r.id for r in rows}
    assert len(rows) == len({(r.qid, r.id) for r in rows}) == len(queries) * len(items)
    assert {r.qid for r in rows if r.picked} == queries and not all(r.picked for r in rows)


def test_words_of_texts_come_from_bounded_batches(spark):
    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", spark.newSession().conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame([("Café & café", 1)], "t string, k int")
    held = spark.conf.get(key)
    try:
        for given, left in ((own, str(4 << 20)), ("1000000", "1000000")):
            spark.conf.set(key, given)
            assert {tuple(r) for r in names.used_words(df, "t", "k").collect()} == {(1, "cafe"), (1, "and")}
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, held)


@pytest.mark.parametrize("size", [search.QUERY_BYTES, 2000])
def test_ranks_are_taken_of_bounded_shares_of_the_candidates(spark, monkeypatch, size):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 4))
    items = spark.createDataFrame([(i, i % 3, i % 20, v.tolist(), 0.0) for i, v in enumerate(vectors)], "id long, category int, creator long, vector array<double>, penalty double").repartition(2)
    queries = spark.createDataFrame([(q, -1, vectors[q].tolist()) for q in range(40)], "qid long, qcreator long, qvector array<double>")
    monkeypatch.setattr(search, "RANKED", 50)
    monkeypatch.setattr(search, "QUERY_BYTES", size)
    rows = search.scores(items, queries, 5, per_creator=False)
    held = [sum(1 for _ in p) for p in rows.rdd.glom().collect()]
    assert len(held) >= 12 and sum(held) >= 40 * 3 * 5 and max(held) <= 0.4 * sum(held)
    got = {(r.qid, r.category, r.id) for r in search.nearest(items, queries, 5, per_creator=False).collect()}
    near = np.round(vectors[:40] @ vectors.T, 6)
    assert got == {(q, c, i) for q in range(40) for c in range(3) for i in sorted(range(c, 300, 3), key=lambda i: (-near[q, i], i))[:5]}
