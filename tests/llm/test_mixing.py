"""Mixing on rows that the fit has not seen, targets one by one, and rows that must stay."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import mixing

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def large(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = mixing.fit_classifier(docs, labels)
    return docs, labels, model, mixing.memberships(docs, model).cache()


def test_toxic_recall_outside_the_sample(large):
    _, labels, model, table = large
    rows = labels.select("doc_id", mixing.domain_of().alias("domain")).where("domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = {r.doc_id: r.domain for r in rows.join(mixing.fitted_sample(rows), "doc_id", "left_anti").collect()}
    hits = {d: [] for d in model.domains}
    for r in table.collect():
        if r.doc_id in known:
            hits[known[r.doc_id]].append(model.domains[int(np.argmax(r.p))] == known[r.doc_id])
    assert len(hits["toxic"]) > 150 and np.mean(hits["toxic"]) > 0.6 and np.mean(hits["good"]) > 0.95


def test_each_total_meets_its_own_target(large):
    _, _, model, table = large
    for least in (None, np.array([1.0, 1.0, 0.0])):
        steps, got, goal = mixing.fit_rates(table, model.domains, mixing.TARGETS, least=least)
        assert np.allclose(got, goal, rtol=1e-3)
        rows = table.collect()
        n, p = np.array([r.n_tokens for r in rows], float), np.array([r.p for r in rows])
        assert np.allclose((mixing.rates(n, p, steps, least) * n) @ p, goal, rtol=1e-3)


def test_targets_out_of_reach_are_reported(spark, caplog):
    table = spark.createDataFrame([(i, 10, [0.5, 0.5]) for i in range(20)], "doc_id long, n_tokens long, p array<double>")
    _, got, goal = mixing.fit_rates(table, ["good", "toxic"], {"good": 2.0, "toxic": 0.1})
    assert not np.allclose(got, goal, rtol=0.1) and "no rates meet the targets" in caplog.text
    assert np.isfinite(got).all()


def test_mix_keeps_every_clean_row(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        toxic, plain = i % 6 == 0, i % 6 == 1
        words = [f"w{rng.randrange(300)}" for _ in range(30)] + (["moron,", "trash."] if toxic else ["a|", "b%%%"] if plain else [])
        docs.append((i, " ".join(words)))
        labels.append((i, int(not toxic and not plain), int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clean = {r.doc_id for r in mixing.mix_rates(d, lab).collect() if r.domain != "toxic"}
    kept = {r.doc_id for r in mixing.mix(d, lab).collect()}
    assert clean and clean <= kept and len(kept) < 600
