import os

import numpy as np
import pytest

from pageloom.llm import toxicity as module
from pageloom.llm.toxicity import NoisyOr, fit_weights, toxicity, without_toxic
from tests.llm.conftest import odd_rows, prose


def test_located_sentences(spark):
    docs, labels = [], []
    for i in range(300):
        sentences = [prose(1000 * i + k, 9).replace(".", "") for k in range(1 + i % 12)]
        if i % 3 == 0:
            sentences[i % len(sentences)] += " you zorkhead" + ("s" if i % 2 else "")
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(i % 3 == 0)))
    docs_ = spark.createDataFrame(docs, "doc_id long, text string")
    labels_ = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity(docs_, labels_).collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 30
    for r in held:
        text = dict(docs)[r["doc_id"]]
        assert r["predicted"] == (r["doc_id"] % 3 == 0)
        spans = [text[a:b] for a, b in r["spans"]]
        assert all("zorkhead" in s for s in spans) and len(spans) == r["predicted"]
    kept = without_toxic(docs_, labels_)
    assert kept.columns == ["doc_id", "text"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if i % 3}


def test_slope_of_the_loss():
    """The fit reaches a lower loss than nearby weights."""
    bags = [(1, [[0], [1, 2]]), (0, [[1]]), (0, [[2], [2]]), (1, [[0, 1]]), (0, [])]
    label = np.array([y for y, _ in bags])
    owner = np.array([i for i, (_, held) in enumerate(bags) for _ in held])
    lists = [s for _, held in bags for s in held]
    size = np.array([len(s) for s in lists], dtype=np.uint16)
    column = np.array([f for s in lists for f in s])
    weights, bias = fit_weights(label, owner, size, column, 3, steps=3000, rate=0.02, ridge=0.05)

    def loss(w, b):
        total = 0.0
        for y, held in bags:
            a = np.logaddexp(0, [b + sum(w[f] for f in s) for s in held]).sum()
            total += -np.log(-np.expm1(-a)) if y else a
        return total / len(bags) + 0.05 / len(bags) ** 0.5 * (np.square(w).sum() / 2)

    best = loss(weights, bias)
    for i in range(3):
        for step in (-0.05, 0.05):
            moved = weights.copy()
            moved[i] += step
            assert loss(moved, bias) >= best - 1e-6
    assert loss(weights, bias + 0.05) >= best - 1e-6 and loss(weights, bias - 0.05) >= best - 1e-6


def test_bags_stay_with_the_executors(spark, monkeypatch):
    """Many rows of one id do not come to the driver, and the fit is the same."""
    rows, labels_ = [], []
    for i in range(60):
        text = prose(i, 20) + (" zorkhead" if i % 3 == 0 else "") + "."
        rows += [(i, text)] * (300 if i == 3 else 1) + [(i, prose(500 + i, 9))]
        labels_.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels_, "doc_id long, toxic int")
    seen = []

    def recorded(label, *args, **more):
        seen.append(len(label))
        return fit_weights(label, *args, **more)

    monkeypatch.setattr(module, "fit_weights", recorded)
    here = module.train(docs, labels, held=None)
    assert here.weights and max(seen) <= 120
    seen.clear()
    monkeypatch.setattr(module, "_LOCAL", 0, raising=False)
    there = module.train(docs, labels, held=None)
    assert not seen
    assert (there.weights, there.bias) == (here.weights, here.bias)


def test_long_joined_words(spark, monkeypatch):
    """Grams of words of any length are learned and found."""
    glued = "_".join(["house"] * 12)
    assert NoisyOr({"zork": 5.0}, -1.0).score(f"{glued}_zorkhead_{glued}.", 0.5)[1] == [(0, 2 * len(glued) + 11)]
    rows = [(i, f"{glued}{i}_{'zorkhead' if i % 2 else 'water'}_{glued}.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(module, "_TEXT", 50, raising=False)
    assert {r["doc_id"] for r in without_toxic(docs, labels).collect()} == set(range(0, 40, 2))


def test_noisy_or():
    model = NoisyOr({"=bad": 3.0, "=poor": 0.5}, -1.0)
    p = 1 / (1 + np.exp(0.5)), 1 / (1 + np.exp(-2.0))
    text = "Fine. Poor. BAD one! Fine."
    assert abs(model.score(text, 0.5)[0] - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-12
    assert model.score(text, 0.5)[1] == [(11, 20)]
    assert model.score(" ... ", 0.5) == (0.0, [])


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (5, 0), (6, 1), (6, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity(odd, labels)
    assert found.count() == len(odd_rows())
    assert found.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity(empty, labels).count() == 0
    assert toxicity(odd, labels.limit(0)).filter("predicted = 0").count() == len(odd_rows())
    assert without_toxic(odd, labels.limit(0)).columns == odd.columns


def test_held_out_labels(spark):
    """Recall of toxic documents and false alarms, each on rows that the fit did not see."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger tables")
    documents, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["predicted"] for r in found if r["toxic"] == 1]
    clean = [r["predicted"] for r in found if r["toxic"] == 0]
    assert len(toxic) > 50 and len(clean) > 500
    assert np.mean(toxic) >= 0.85
    assert np.mean(clean) <= 0.005
