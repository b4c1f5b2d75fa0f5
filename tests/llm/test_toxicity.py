"""Ordinal fit on made data, and accuracy on labels that the fit hasn't seen."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import toxicity as T


def test_ordinal_fit_recovers_order():
    r = np.random.default_rng(0)
    n, d = 4000, 6
    x = r.random((n, d)) < 0.4
    w = np.array([2.0, 1.0, 0.0, -1.0, 0.5, 3.0])
    z = x @ w + r.logistic(size=n)
    y = np.digitize(z, [1.0, 2.5, 4.0])
    rows, cols = np.nonzero(x)
    got, th = T.fit_ordinal(rows, cols, y, d, 4, l2=0)
    assert np.all(np.diff(th) > 0) and np.allclose(got, w, atol=0.3) and np.allclose(th, [1, 2.5, 4], atol=0.3)
    m = T.Model({}, list(th), [0, 1, 2, 3])
    s = m.severity(np.array([-50.0, 0.0, 2.0, 50.0]))
    assert np.all(np.diff(s) > 0) and abs(s[0]) < 1e-6 and abs(s[-1] - 3) < 1e-6


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0
    model = T.fit(docs, labels.filter(seen))
    got = T.score(docs, model).join(labels.filter(~seen).select("doc_id", F.col("toxic").alias("y")), "doc_id").groupBy("y", "toxic").count().collect()
    n = {(r["y"], r["toxic"]): r["count"] for r in got}
    # some 3,200 labels in four languages; with 4,000 of the larger tables all are found and none is wrong
    assert n.get((1, True), 0) >= 0.85 * (n.get((1, True), 0) + n.get((1, False), 0)) > 0
    assert n.get((0, True), 0) <= 0.02 * n[(0, False)]


def test_grades_of_labels_are_learnt(spark):
    """Texts whose labels grow with what they hold: held-out severity and grade follow the labels' order."""
    r = np.random.default_rng(3)
    rows = []
    for i in range(900):
        g = int(r.choice(4, p=[0.55, 0.2, 0.15, 0.1]))
        words = [f"w{r.integers(60)}" for _ in range(30)] + ["mild"] * (g >= 1) + ["harsh"] * (g >= 2) + ["vile"] * (g >= 3)
        rows.append((i, " ".join(words), g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, g int").cache()
    model = T.fit(docs, docs.filter("doc_id < 600"), grade=F.col("g") * 2, max_rows=500)
    assert model.levels == [0, 2, 4, 6] and len(model.thresholds) == 3
    out = T.score(docs.filter("doc_id >= 600"), model, at_least=0.5).join(docs.select("doc_id", "g"), "doc_id").collect()
    mean = [np.mean([r["severity"] for r in out if r["g"] == g]) for g in range(4)]
    assert all(np.diff(mean) > 1) and np.mean([r["grade"] == 2 * r["g"] for r in out]) > 0.9


def test_the_sample_is_bounded(spark):
    """One id that a third of all rows have, in equal and in different texts."""
    kind = "doc_id long, text string"
    rows = [(0, f"bad thing {i % 700}") for i in range(3000)] + [(i, f"good thing {i} is here") for i in range(1, 200)] + [(500, "very " * 60_000)]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(i, int(i == 0)) for i in range(200)] * 3, "doc_id long, toxic int")
    seen = []
    plain = T.fit_ordinal
    T.fit_ordinal = lambda rows, cols, y, *a, **k: (seen.append(len(y)), plain(rows, cols, y, *a, **k))[1]
    try:
        model = T.fit(docs, labels, max_rows=300)
    finally:
        T.fit_ordinal = plain
    assert seen == [300]
    assert all(r["toxic"] == (r["doc_id"] == 0) for r in T.score(docs, model).collect() if r["doc_id"] != 500)


def test_edge_tables(spark):
    kind, labelled = "doc_id long, text string", "doc_id long, toxic int"
    empty, none = spark.createDataFrame([], kind), spark.createDataFrame([], labelled)
    some = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (2, "")], kind).withColumns({"severity": F.lit("s"), "y": F.lit(1)})
    flat = T.fit(some, none)
    assert T.score(empty, flat).count() == 0
    assert [(r["severity"], r["toxic"]) for r in T.score(some, flat).collect()] == [(0.0, False)] * 4
    one = spark.createDataFrame([(1, 1), (1, 1), (9, 0), (None, 1), (2, None)], labelled)
    assert T.score(some, T.fit(some, one)).count() == 4
    texts = spark.createDataFrame([(i, "you idiot scum" if i % 3 == 0 else f"fine words {i}") for i in range(60)], kind)
    marks = texts.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = {r["doc_id"]: r for r in T.score(texts, T.fit(texts, marks)).collect()}
    assert all(got[i]["toxic"] == (i % 3 == 0) for i in range(60)) and got[0]["severity"] > got[1]["severity"]


def test_scores_by_hand(spark):
    """Severities and grades of every text against sums, chances and expectations worked out one by one."""
    texts = ["you idiot idiot", "fine words here", "", None, "idiot scum and words", "IDIOT! scum.", "wordsmith fine " * 2000]
    seen = [T.features_of(t) for t in texts]
    names = sorted({f for s in seen for f in s})
    r = random.Random(8)
    model = T.Model({f: r.uniform(-1, 1) for f in names if r.random() < 0.7}, [-0.3, 0.9, 1.4], [0, 1, 3, 4])
    got = {x["doc_id"]: x for x in T.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, at_least=0.4).collect()}
    for i, features in enumerate(seen):
        total = sum(w for f, w in model.weights.items() if f in features)
        reach = [1 / (1 + math.exp(t - total)) for t in model.thresholds]  # P(grade >= level 1, 2, 3)
        exactly = [1 - reach[0], reach[0] - reach[1], reach[1] - reach[2], reach[2]]
        assert got[i]["severity"] == pytest.approx(sum(p * level for p, level in zip(exactly, model.levels)))
        assert got[i]["grade"] == max([0, *(level for p, level in zip(reach, model.levels[1:]) if p > 0.4)])


def test_fit_is_a_maximum_of_the_likelihood():
    """No small step of a weight or threshold makes the labelled grades likelier."""
    r = np.random.default_rng(2)
    x = (r.random((400, 5)) < 0.4).astype(float)
    y = np.digitize(x @ np.array([1.5, -1.0, 0.7, 0.0, 2.0]) + r.logistic(size=400), [0.5, 2.0])
    rows, cols = np.nonzero(x)
    w, th = T.fit_ordinal(rows, cols, y, 5, 3, steps=3000)

    def loss(w, th):
        score = x @ w
        chance = lambda k: 1 / (1 + np.exp(th[k] - score))
        up = np.stack([np.ones(400), chance(0), chance(1), np.zeros(400)])
        return -np.log(up[y, np.arange(400)] - up[y + 1, np.arange(400)]).mean() + 0.5e-4 * (w**2).sum()

    best = loss(w, th)
    for i in range(7):
        for step in (-0.05, 0.05):
            p = np.concatenate([w, th])
            p[i] += step
            assert loss(p[:5], p[5:]) > best - 1e-6
