"""Kernel machines: features, duality gap, subgradients, held-out quality."""
import numpy as np
import pytest

from flankwear.operators import kernel as ke
from flankwear.operators import trees as tr


def table(spark, task, n=150):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) + 0.3 * x[:, 1] if task == "r" else (np.hypot(x[:, 0], x[:, 1]) > 1.1).astype(float) + (x[:, 2] > 1.2) * (task == "3")
    rows = [(i, i % 3, float(y[i]), [float(v) * 50 + 7 for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, fold int, label double, vec array<double>").repartition(3), x * 50 + 7, y


def test_features_reproduce_the_kernel_of_landmarks():
    x = np.random.default_rng(1).normal(size=(30, 4))
    f = ke.Features(x.mean(0), x.std(0), x)
    z = f.of(x)[:, :-1]
    assert z @ z.T == pytest.approx(f.kernel(f.scaled(x)), abs=1e-6)
    assert f.of(np.full((1, 4), np.nan)).shape == (1, f.root.shape[1] + 1)


def test_regression_gap_and_subgradients(spark):
    df, x, y = table(spark, "r")
    rows = tr.training_rows(df)
    m = ke.fit(rows, range(3), None)
    assert all(-1e-6 <= g < 0.05 for g in m.gap.values()), m.gap
    fold = np.arange(len(y)) % 3
    for f in range(3):
        use = fold != f
        z, w = m.features[f].of(x[use]), m.w[f, None]
        r = z @ w - y[use]
        exact = lambda v: v[:-1] @ v[:-1] / 2 + ke.C * np.maximum(0, np.abs(z @ v - y[use]) - ke.EPSILON).sum()
        assert np.mean(np.abs(r) > ke.EPSILON + 0.01) < 0.5
        rng = np.random.default_rng(f)
        for _ in range(40):                                   # no direction descends: the problem is convex
            d = rng.normal(size=len(w))
            assert exact(w + 0.01 * d / np.linalg.norm(d)) >= exact(w) * (1 - 0.05)
    out = ke.oof(df, range(3), None).collect()
    assert len(out) == len(y) and np.mean([(p.y_pred - p.y_true) ** 2 for p in out]) < 0.35 * np.var(y)


@pytest.mark.parametrize("task,classes", [("2", 2), ("3", 3)])
def test_classification_out_of_fold(spark, task, classes):
    df, _, y = table(spark, task)
    rows = tr.training_rows(df)
    m = ke.fit(rows, range(3), classes)
    assert all(-1e-6 <= g < 0.05 for g in m.gap.values()), m.gap
    out = ke.oof(df, range(3), classes).collect()
    assert sorted(p.row_id for p in out) == list(range(len(y))) and np.mean([p.y_pred == p.y_true for p in out]) > 0.8
