"""The baseline classifier against a plain Newton solver, its threshold and its edge cases."""

import numpy as np
import pytest

from riskgraph.plans import scoring


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.standard_normal(3)
        label = int(x[0] - 0.5 * x[1] + 0.3 * rng.standard_normal() > 0.8) if i % 7 else None
        rows.append((i % 10, i, i % 3 if i % 11 else -1, label, [float(v) for v in x]))
    return rows, spark.createDataFrame(rows, "snapshot int, node_id long, split int, label int, x array<double>")


def newton(rows, iterations, ridge):
    fit = [(x, y) for _, _, split, y, x in rows if split == 0 and y is not None]
    x, y = np.array([[1.0, *f] for f, _ in fit]), np.array([float(v) for _, v in fit])
    weight = min(max((y == 0).sum() / max((y == 1).sum(), 1), 0.02), 50.0)
    w, beta, penalty = np.where(y == 1, weight, 1.0), np.zeros(x.shape[1]), np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x.T * (w * p * (1 - p))) @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
    return beta, weight


def test_newton_steps_equal_a_plain_solver(spark):
    rows, df = table(spark)
    trained = scoring.train_baseline(df.repartition(5), 6, 0.5)
    beta, weight = newton(rows, 6, 0.5)
    assert np.allclose(trained.coefficients, beta, atol=1e-8) and trained.pos_weight == pytest.approx(weight)
    got = {r.node_id: r.prob for r in trained.scores.collect()}
    assert len(got) == len(rows)
    for _, node, _, _, x in rows:
        assert got[node] == pytest.approx(1 / (1 + np.exp(-(beta[0] + np.dot(beta[1:], x)))), abs=1e-9)


def test_threshold_reads_validation_labels_only(spark):
    rows, df = table(spark)
    bent = spark.createDataFrame([(s, n, split, 1 - y if split == 2 and y is not None else y, x) for s, n, split, y, x in rows], df.schema)
    assert scoring.train_baseline(df).threshold == scoring.train_baseline(bent).threshold


def test_baseline_without_training_labels(spark):
    _, df = table(spark, 20)
    trained = scoring.train_baseline(df.withColumn("split", df.split * 0 + 2))
    assert trained.coefficients == [0.0] * 4 and trained.threshold == 0.5 and {r.prob for r in trained.scores.collect()} == {0.5}
    assert scoring.train_baseline(df.limit(0)).scores.count() == 0


@pytest.mark.parametrize("mode, want", [("text_mlp", [0.5, 1.0]), ("graph_only", [7.0]), ("concat", [0.5, 1.0, 7.0])])
def test_features_of_each_mode(spark, mode, want):
    grid = spark.createDataFrame([(0, 1), (0, 2)], "snapshot int, node_id long")
    slots = spark.createDataFrame([(0, 1, [0.0, 2.0]), (0, 1, [1.0, 0.0])], "snapshot int, node_id long, vector array<double>")
    static = spark.createDataFrame([(1, [7.0]), (2, [8.0])], "node_id long, features array<double>")
    got = {r.node_id: r.x for r in scoring.features(grid, slots, static, mode, 2).collect()}
    assert got[1] == want and got[2] == [0.0 if mode != "graph_only" else 8.0, 0.0, 8.0][: len(want)]
    with pytest.raises(ValueError):
        scoring.features(grid, slots, static, "other", 2)
