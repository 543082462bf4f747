"""Machines fitted in shared passes against exact optima, the library's own trainer, and each other."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import DenseVector, SparseVector

from flowmark.functions import blocks
from flowmark.functions.blocks import vector_rows
from flowmark.operators import margins
from flowmark.operators.margins import Machine, Variant, View, fit_machines, scores
from flowmark.operators.svm import fit_svm, predict


def hinge(x, y, weights, intercept):
    return np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x @ weights + intercept)).mean()


def points(n, d, seed, noise=1.0, share=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 50, d) + rng.normal(size=d) * 10
    side = (x - x.mean(0)) / x.std(0) @ rng.normal(size=d) + noise * rng.normal(size=n)
    return x, (side > np.quantile(side, 1 - share)).astype(float)


def frame(spark, x, y, parts=3, sparse=False):
    def vector(row):
        return SparseVector(len(row), [(i, float(v)) for i, v in enumerate(row) if v]) if sparse else DenseVector(row)

    rows = [(float(label), vector(row)) for row, label in zip(x, y)]
    return spark.createDataFrame(rows, ["label", "features"]).repartition(parts)


def least(x, y):
    """The least loss: it is taken where as many rows as there are weights lie on their margin."""
    sign, n = np.where(y > 0, 1.0, -1.0), x.shape[1] + 1
    full = np.column_stack([x, np.ones(len(x))])
    best = min(np.mean(sign > 0), np.mean(sign < 0)) * 2
    for chosen in combinations(range(len(x)), n):
        chosen = list(chosen)
        if abs(np.linalg.det(full[chosen])) > 1e-9:
            v = np.linalg.solve(full[chosen], sign[chosen])
            best = min(best, hinge(x, y, v[:-1], v[-1]))
    return best


@pytest.mark.parametrize("n, d, seed", [(200, 1, 1), (25, 2, 2), (25, 2, 3)])
def test_least_loss(spark, n, d, seed):
    x, y = points(n, d, seed)
    (fit,) = fit_machines(vector_rows(frame(spark, x, y)).cache(), {0: [View()]}, {0: d}, [Machine(0, 0, d, 1.0)], 100)
    exact = least(x, y)
    assert fit.loss == pytest.approx(hinge(x, y, fit.weights, fit.intercept), rel=1e-9)
    assert exact - 1e-9 <= fit.loss <= exact * 1.001
    assert fit.loss - exact <= fit.gap + 1e-9


@pytest.mark.parametrize("n, d, noise, share", [(600, 8, 1.0, 0.3), (400, 20, 0.0, 0.5)])
def test_no_worse_than_the_library_trainer(spark, n, d, noise, share):
    x, y = points(n, d, 5, noise, share)
    df = frame(spark, x, y, 1).cache()
    (fit,) = fit_machines(vector_rows(df).cache(), {0: [View()]}, {0: d}, [Machine(0, 0, d, 1.0)], 100)
    other = LinearSVC(maxIter=60, regParam=0.0).fit(df)
    assert fit.loss <= hinge(x, y, other.coefficients.toArray(), other.intercept) * 1.001


def test_gap_falls_and_snapshots_are_fits_of_fewer_passes(spark):
    x, y = points(300, 4, 7)
    rows = vector_rows(frame(spark, x, y)).cache()
    args = rows, {0: [View()]}, {0: 4}, [Machine(0, 0, 4, 1.0)]
    (fit,) = fit_machines(*args, 30, (3, 12))
    assert all(g >= 0 for g in fit.gaps) and all(b <= a + 1e-12 for a, b in zip(fit.gaps, fit.gaps[1:]))
    assert all(b <= a for a, b in zip(fit.history, fit.history[1:]))
    for n in (3, 12):
        (short,) = fit_machines(*args, n)
        snap = fit.snapshots[n]
        assert snap.iterations == short.iterations == n
        assert np.allclose(snap.weights, short.weights) and snap.loss == pytest.approx(short.loss)
        assert snap.gap == pytest.approx(short.gap)


def test_one_pass_serves_all_machines(spark, monkeypatch):
    x, y = points(300, 5, 8)
    z, w = points(200, 3, 9)
    projection = np.random.default_rng(1).normal(size=(5, 3))
    centre = x.mean(0)
    rows = vector_rows(frame(spark, x, y), 0).unionByName(vector_rows(frame(spark, z, w), 1)).cache()
    machines = [Machine(0, 0, 5, 1.0), Machine(0, 1, 1, 1.0), Machine(0, 1, 3, 0.0), Machine(1, 0, 3, 1.0)]
    views = {0: [View(), View(projection, centre)], 1: [View()]}
    passes = []
    real = margins.added
    monkeypatch.setattr(margins, "added", lambda *a: passes.append(1) or real(*a))
    together = fit_machines(rows, views, {0: 5, 1: 3}, machines, 25)
    assert len(passes) <= 26
    shown = (x - centre) @ projection
    alone = [(x, y), (shown[:, :1], y), (shown, 1 - y), (z, w)]
    for fit, (a, b) in zip(together, alone):
        d = a.shape[1]
        (own,) = fit_machines(vector_rows(frame(spark, a, b)).cache(), {0: [View()]}, {0: d}, [Machine(0, 0, d, 1.0)], 25)
        assert fit.loss == pytest.approx(own.loss, rel=2e-3)
    judged = scores(rows, views, machines, together, [Variant(0, (1,), 0.0), Variant(0, (0, 2), None), Variant(1, (3,), 0.5)])
    counts = {r.variant: r["count"] for r in judged.groupBy("variant").count().collect()}
    assert counts == {0: 300, 1: 300, 2: 200}


@pytest.mark.parametrize("collect_bytes", [64 << 20, 1])
def test_sparse_rows_and_merged_tasks(spark, monkeypatch, collect_bytes):
    monkeypatch.setattr(blocks, "COLLECT_BYTES", collect_bytes)
    monkeypatch.setattr(blocks, "SPARSE_BLOCK", 50)
    rng = np.random.default_rng(3)
    x, y = points(240, 6, 11)
    x[rng.random(x.shape) < 0.6] = 0
    dense, sparse = frame(spark, x, y, 7), frame(spark, x, y, 7, sparse=True)
    mixed = dense.limit(100).union(sparse.limit(140))
    fits = [fit_svm(df.cache(), "binary", 15) for df in (dense, sparse)]
    assert np.allclose(fits[0].fits[0].weights, fits[1].fits[0].weights)
    a, b = (sorted(r.scores[1] for r in predict(fits[0], df).collect()) for df in (dense, sparse))
    assert np.allclose(a, b)
    assert predict(fits[0], mixed).count() == 240


def test_constant_columns_and_single_labels(spark):
    x = np.column_stack([np.full(40, 3e9), np.arange(40.0)])
    model = fit_svm(frame(spark, x, (np.arange(40) > 20).astype(float)).cache(), "binary", 30)
    assert model.fits[0].weights[0] == 0 and model.fits[0].loss < 1e-6
    alone = fit_svm(frame(spark, x, np.zeros(40)).cache(), "binary", 5)
    assert alone.fits[0].loss == 0 and predict(alone, frame(spark, x, np.zeros(40))).filter("prediction = 1").isEmpty()


def test_classes(spark):
    x, _ = points(300, 2, 12)
    y = np.argmax(np.column_stack([x[:, 0] / 10, -x[:, 0] / 10, np.full(300, 0.2)]), axis=1)
    model = fit_svm(frame(spark, x, y.astype(float)).cache(), "multinomial", 40)
    rows = predict(model, frame(spark, x, y.astype(float))).collect()
    assert len(model.fits) == 3 and all(len(r.scores) == 3 and r.prediction == np.argmax(r.scores) for r in rows)
    assert np.mean([r.label == r.prediction for r in rows]) > 0.6


def test_groups_without_rows_are_refused(spark):
    rows = vector_rows(frame(spark, *points(10, 2, 1)))
    with pytest.raises(ValueError, match="no training rows"):
        fit_machines(rows, {0: [View()], 1: [View()]}, {0: 2, 1: 2}, [Machine(1, 0, 2, 1.0)], 3)
