"""Losses sum before they shuffle, at any size of their scores."""

import numpy as np
import pytest

from manyvec.operators import losses


def table(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "qid long, pid long, score double").repartition(3)


def log_sum(x):
    top = x.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]


@pytest.mark.parametrize("size", [1.0, 50.0, 5000.0])
def test_sums_by_steps_equal_log_sums(spark, size):
    rng = np.random.default_rng(int(size))
    x, t = rng.normal(size=(6, 9)) * size, rng.normal(size=(6, 9)) * size
    found = losses.in_batch(table(spark, x), temperature=1.0).first()["loss"]
    assert found == pytest.approx(float((log_sum(x) - np.diag(x)).mean()), rel=1e-12)
    p = np.exp(t - log_sum(t)[:, None])
    want = float((p * (t - log_sum(t)[:, None] - x + log_sum(x)[:, None])).sum(axis=1).mean())
    assert losses.distillation(table(spark, x), table(spark, t), temperature=1.0).first()["loss"] == pytest.approx(want, rel=1e-9)


def test_the_hardest_document_is_never_the_positive(spark):
    x = np.array([[3.0, 1.0, 2.0], [5.0, 5.0, 1.0], [0.0, 4.0, 9.0]])
    hardest = np.array([2.0, 5.0, 4.0])
    want = np.log1p(np.exp(hardest - np.diag(x))).mean()
    assert losses.pairwise(table(spark, x)).first()["loss"] == pytest.approx(float(want))
    assert losses.pairwise(table(spark, x[:1, :1])).first()["loss"] is None  # nothing to compare with


@pytest.mark.parametrize("loss", [losses.in_batch, losses.pairwise, losses.sigmoid, lambda s: losses.multi_positive(s, s.where("qid = pid"))])
def test_no_pair_is_sorted_or_shuffled_alone(spark, loss):
    scores = spark.range(100).selectExpr("id div 10 AS qid", "id % 10 AS pid", "rand(1) AS score")
    p = loss(scores)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in p and "partial_" in p
