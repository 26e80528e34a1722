import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrain.llm import common, mixing


def test_classifier_tells_domains_apart(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    unseen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = mixing.train(docs, labels.where(~unseen))
    rows = docs.join(labels.where(unseen), "doc_id").select("text", "quality", "toxic").collect()
    raw = [(r["text"] or "").encode() for r in rows]
    off = np.cumsum([0, *map(len, raw)])
    _, p = model.posteriors(np.frombuffer(b"".join(raw), np.uint8), off)
    np.testing.assert_allclose(p.sum(1), 1)
    truth = np.array([2 if r["toxic"] else 1 if r["quality"] == 0 else 0 for r in rows])
    assert (p.argmax(1) == truth).mean() > 0.9
    assert (p.argmax(1) == 2)[truth == 2].mean() > 0.7
    assert (p.argmax(1) == 2)[truth != 2].mean() < 0.02


def test_totals_match_targets(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    found = mixing.rates(docs, labels).toPandas()
    assert len(found) == 1000 and (found.rate >= 0).all()
    p = found[["p_high", "p_low", "p_toxic"]].to_numpy()
    np.testing.assert_allclose(p.sum(1), 1)
    totals = (found.n_tokens.to_numpy() * found.rate.to_numpy())[:, None] * p
    totals = totals.sum(0)
    np.testing.assert_allclose(totals / totals.sum(), [0.80, 0.17, 0.03], atol=2e-3)
    assert ((found.copies - found.rate).abs() < 1).all()
    assert (found.copies[found.p_high > 0.99] >= 1).all()


def test_against_brute_force_least_squares(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.2, 0.2], 400)
    n = rng.integers(1, 100, 400)
    table = spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(n, p)], "_n long, _p array<double>")
    steps, goal = mixing.solve(table, {"high": 0.2, "low": 0.75, "toxic": 0.05}, 1.0)
    got = np.array([r[0] for r in table.select(mixing.rate(steps)).collect()])
    r = np.ones(400)
    for a in steps:
        r = np.maximum(0, r - p @ a)
    np.testing.assert_allclose(got, r, rtol=1e-9)
    np.testing.assert_allclose((r * n) @ p, goal, rtol=0, atol=2e-4 * goal.sum())
    assert (r == 0).any()


def test_edge_cases(spark):
    kinds = "doc_id long, text string, rate double, copies string"
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in enumerate([None, "", "  ", "good words", "good words", "bad stuff", "x " * 100_000])] + [(3, "good words", 1.0, "x")], kinds)
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (3, 1, 0), (None, 1, 1), (4, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    found = mixing.rates(docs, labels)
    assert found.count() == 8
    by = {}
    for r in found.collect():
        by.setdefault(r["doc_id"], set()).add(round(r["rate"], 9))
    assert by[3] == by[4] and by[0] == by[1] == by[2]
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns
    assert mixing.rates(docs.limit(0), labels).count() == 0
    assert mixing.rates(docs, labels.limit(0)).where("rate < 1").count() == 0
    assert mixing.mix(docs.limit(0), labels.limit(0)).count() == 0
