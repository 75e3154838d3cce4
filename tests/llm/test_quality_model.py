"""Held-out accuracy, and the compiled rules against evaluating them by hand."""

import random
import zlib

import numpy as np

from pagewright.llm.quality_model import STATS, fit, holds, learn, lasso_logistic, score, statistics


def corpus(n=600):
    rng = random.Random(4)
    pool = ["stone", "river", "über", "nación", "walk", "and", "the", "of"]
    documents, labels = [], []
    for i in range(n):
        words = rng.choices(pool, k=rng.randrange(1, 150))
        good = rng.random() < 0.75
        if not good:
            kind = rng.randrange(3)
            words = [w + "%%%" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * len(words)
        documents.append((i, " ".join(words) + "."))
        labels.append((i, int(good), 0))
    return documents, labels


def test_held_out_accuracy_and_compiled_rules(spark):
    documents, labels = corpus()
    extra = [(5000, None), (5001, ""), (5001, " \n"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 3) for d, t in documents + extra], "doc_id long, text string, score int")
    marks = spark.createDataFrame(labels + [(1, None, 0), (None, 1, 0), (0, labels[0][1], 1)], "doc_id long, quality int, toxic int")
    model = learn(df, marks)
    rows = score(df, model).collect()
    assert len(rows) == len(documents) + len(extra)
    truth = {d: q for d, q, _ in labels}
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    bias, rules = model
    x = np.array([statistics((t or "").encode()) for _, t in documents + extra])
    by_hand = 1 / (1 + np.exp(-(bias + holds([r for _, r in rules], x) @ np.array([w for w, _ in rules]))))
    assert np.allclose(sorted(by_hand), sorted(r.score for r in rows))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_that_teach_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [round(r.score, 2) for r in score(df, learn(df, none)).collect()] == [0.5, 0.5]
    assert score(spark.createDataFrame([], "doc_id long, text string"), (0.0, [])).count() == 0
    assert fit(np.zeros((3, len(STATS))), np.ones(3))[1] == []


def test_lasso_drops_weights():
    rng = np.random.default_rng(0)
    z = rng.random((400, 30)) < 0.5
    y = (z[:, 3] ^ (rng.random(400) < 0.05)).astype(float)
    _, w = lasso_logistic(z, y, 0.02)
    assert abs(w[3]) > 1 and (np.abs(w) > 1e-4).sum() < 12
