import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from flowmark.operators import reduction
from flowmark.operators.reduction import (
    ClassState,
    fit_lda,
    fit_lda_wide,
    fit_pca,
    fit_scatter,
    lda_project,
    pca_project,
    variance_table,
)

CENTRES = [(0.0, 0.0, 0.0), (4.0, 1.0, 0.0), (0.0, 5.0, 2.0)]
SHIFTS = [(0.1, 0.2, 0.0), (-0.2, 0.1, 0.3), (0.3, -0.1, -0.2), (-0.1, -0.2, 0.1)]


def table(spark, points, labels, parts=3):
    rows = [(i, float(c), [float(v) for v in p]) for i, (p, c) in enumerate(zip(points, labels))]
    df = spark.createDataFrame(rows, "uid int, label double, x array<double>").repartition(parts)
    return df.select("uid", "label", array_to_vector("x").alias("features"))


@pytest.fixture()
def clusters(spark):
    points = [np.add(c, s) for c in CENTRES for s in SHIFTS]
    return table(spark, points, np.repeat(range(3), 4))


def collect(df):
    rows = df.select("uid", vector_to_array("features").alias("f")).orderBy("uid").collect()
    return np.array([r.f for r in rows])


def textbook(points, labels):
    """Per-class scatter and the eigenproblem of pinv(within) @ between."""
    points, labels = np.asarray(points, float), np.asarray(labels)
    overall = points.mean(axis=0)
    within = between = 0
    for c in np.unique(labels):
        own = points[labels == c]
        d = own - own.mean(axis=0)
        within = within + d.T @ d
        gap = own.mean(axis=0) - overall
        between = between + len(own) * np.outer(gap, gap)
    values, vectors = np.linalg.eig(np.linalg.pinv(within, hermitian=True) @ between)
    order = np.argsort(values.real)[::-1]
    return overall, within, between, values.real[order], vectors.real[:, order]


def test_dimension_and_ratios(spark, clusters):
    train, test = clusters.filter("uid % 4 <> 3"), clusters.filter("uid % 4 = 3")
    pca = fit_pca(train, 2)
    assert collect(pca_project(test, pca, 2)).shape == (3, 2)
    assert 0 <= sum(pca.explainedVariance) <= 1.0000001
    for normalise in ("unit", "whiten"):
        lda = fit_lda(train, 2, normalise)
        assert collect(lda_project(test, lda, 2)).shape == (3, 2)
        assert sum(lda.ratios) == pytest.approx(1.0)


def test_smaller_counts_are_prefixes(spark, clusters):
    whole = fit_pca(clusters, 3)
    for k in (1, 2):
        alone = fit_pca(clusters, k)
        assert np.allclose(collect(pca_project(clusters, whole, k)), collect(pca_project(clusters, alone, k)))
        assert np.allclose(whole.explainedVariance.toArray()[:k], alone.explainedVariance.toArray())
    lda = fit_lda(clusters, 2)
    assert np.allclose(collect(lda_project(clusters, lda, 1)), collect(lda_project(clusters, lda, 2))[:, :1])


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_scatter_and_directions_equal_textbook(spark, shift):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 4, 500)
    points = rng.normal(size=(500, 6)) + labels[:, None] * [1, 0, 2, 0, -1, 0.3] + shift
    df = table(spark, points, labels, parts=7)
    scatter = fit_scatter(df)
    overall, within, between, values, vectors = textbook(points, labels)
    assert np.allclose(scatter.within, within, rtol=1e-7)
    assert np.allclose(scatter.between, between, rtol=1e-6, atol=1e-6)
    lda = fit_lda(df, 3)
    assert np.allclose(lda.ratios, values[:3] / np.maximum(values, 0).sum(), atol=1e-6)
    for j in range(3):
        cosine = lda.projection[:, j] @ vectors[:, j] / np.linalg.norm(vectors[:, j])
        assert abs(abs(cosine) - 1) < 1e-6
        assert lda.projection[np.abs(lda.projection[:, j]).argmax(), j] > 0
    got = collect(lda_project(df, lda, 3))
    assert np.allclose(got, (points - overall) @ lda.projection, atol=1e-6)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, 300)
    points = rng.normal(size=(300, 4)) * [1, 10, 0.1, 3] + labels[:, None]
    lda = fit_lda(table(spark, points, labels), 2, "whiten")
    _, within, _, _, _ = textbook(points, labels)
    assert np.allclose(lda.projection.T @ within @ lda.projection / (300 - 3), np.eye(2), atol=1e-8)


def test_collinear_and_constant_features(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, 200)
    base = rng.normal(size=(200, 3)) + labels[:, None] * [1, 0, -1]
    points = np.column_stack([base, base[:, 0] - base[:, 1], np.ones(200)])
    lda = fit_lda(table(spark, points, labels), 2)
    assert lda.rank == 3
    _, _, _, values, _ = textbook(base, labels)
    assert np.allclose(lda.ratios, values[:2] / values[:2].sum(), atol=1e-9)


def test_no_spread_within_classes(spark):
    lda = fit_lda(table(spark, [(0, 0), (0, 0), (1, 1)], [0, 0, 1]), 1)
    assert lda.ratios == (0.0,) and lda.rank == 0


def test_too_wide_or_empty(spark, clusters):
    with pytest.raises(ValueError, match="empty"):
        fit_lda(clusters.limit(0), 1)
    with pytest.raises(ValueError, match="driver_bytes"):
        fit_lda(clusters, 1, driver_bytes=100)


def test_more_components_than_rank(spark):
    rng = np.random.default_rng(8)
    labels = np.arange(100) % 5
    points = rng.normal(size=(100, 2)) + labels[:, None]
    df = table(spark, points, labels)
    model = fit_lda(df, 4)
    assert model.rank == 2 and model.projection.shape == (2, 4)
    assert model.ratios[2:] == (0.0, 0.0) and sum(model.ratios) == pytest.approx(1)
    rows = lda_project(df, model, 4).collect()
    assert len(rows) == 100 and all(len(r.features) == 4 and r.features[3] == 0 for r in rows)


def test_variance_table(spark):
    rows = variance_table(spark, [0.5, 0.3], {"task": "t"}).orderBy("component").collect()
    assert [(r.task, r.component, r.explained_variance) for r in rows] == [("t", 1, 0.5), ("t", 2, 0.3)]
    assert rows[1].cumulative_variance == pytest.approx(0.8)


def test_other_columns_stay(spark, clusters):
    df = clusters.withColumn("tag", F.lit("x"))
    assert lda_project(df, fit_lda(df, 1), 1).columns == ["uid", "label", "tag", "features"]
    assert pca_project(df, fit_pca(df, 1), 1).columns == ["uid", "label", "tag", "features"]


def test_components_equal_those_of_the_covariance(spark):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(400, 60)) @ np.diag(np.linspace(1, 3, 60)) @ rng.normal(size=(60, 60)) + 1e4
    model = fit_pca(table(spark, points, np.zeros(400), parts=5), 4)
    values, vectors = np.linalg.eigh(np.cov(points.T))
    assert np.allclose(model.ratios, values[::-1][:4] / values.sum(), rtol=1e-9)
    assert np.allclose(np.abs(np.sum(model.components * vectors[:, ::-1][:, :4], axis=0)), 1, atol=1e-6)
    assert model.residual < 1e-8


def sparse_table(spark, n, width, per_row, seed, classes=3):
    """Rows of a few entries each; some columns go with the class."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = i % classes
        at = np.unique(np.append(rng.integers(0, width, per_row), label * 7))
        rows.append((i, float(label), SparseVector(width, at.tolist(), (rng.normal(size=len(at)) + 2).tolist())))
    return spark.createDataFrame(rows, ["uid", "label", "features"]).repartition(3)


def test_wide_sparse_components(spark):
    df = sparse_table(spark, 200, 50_000, 6, 1).cache()
    model = fit_pca(df, 2, driver_bytes=200 << 20)
    x = np.zeros((200, 50_000))
    for i, row in enumerate(df.collect()):
        x[i, row.features.indices] = row.features.values
    x -= x.mean(axis=0)
    sizes = np.square(np.linalg.svd(x, compute_uv=False))
    assert np.allclose(model.ratios, sizes[:2] / sizes.sum(), rtol=1e-6)
    with pytest.raises(ValueError, match="driver_bytes"):
        fit_pca(df, 2, driver_bytes=1 << 20)


@pytest.mark.parametrize("normalise", ["unit", "whiten"])
def test_wide_lda_equals_the_one_with_matrices(spark, normalise):
    rng = np.random.default_rng(9)
    labels = rng.integers(0, 4, 400)
    points = rng.normal(size=(400, 12)) * np.linspace(0.5, 2, 12) + labels[:, None] * np.linspace(-1, 1, 12) + 50
    df = table(spark, points, labels).cache()
    dense, wide = fit_lda(df, 3, normalise), fit_lda_wide(df, 3, normalise)
    assert np.allclose(dense.ratios, wide.ratios, atol=1e-6)
    assert np.allclose(dense.projection, wide.projection, atol=1e-6 * np.abs(dense.projection).max())


def test_wide_lda_leaves_out_what_has_no_spread(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, 200)
    base = rng.normal(size=(200, 3)) + labels[:, None] * [1, 0, -1]
    points = np.column_stack([base, base[:, 0] - base[:, 1], labels, np.ones(200)])
    df = table(spark, points, labels)
    dense, wide = fit_lda(df, 2), fit_lda_wide(df, 2)
    assert np.allclose(dense.ratios, wide.ratios, atol=1e-6)
    assert np.allclose(dense.projection, wide.projection, atol=1e-5)


def test_fifty_thousand_columns_need_no_matrix(spark):
    df = sparse_table(spark, 300, 50_000, 4, 2).cache()
    model = fit_lda(df, 2, driver_bytes=64 << 20)
    assert model.projection.shape == (50_000, 2) and model.rank is None
    scores = collect(lda_project(df, model, 2))
    assert np.isfinite(scores).all() and sum(model.ratios) == pytest.approx(1)


def test_scatter_takes_one_pass_and_keeps_its_digits(spark, monkeypatch):
    rng = np.random.default_rng(7)
    labels = rng.integers(0, 3, 300)
    points = rng.normal(size=(300, 4)) + labels[:, None]
    wanted = textbook(points, labels)[1]
    passes = []
    real = reduction.merged
    monkeypatch.setattr(reduction, "merged", lambda *a: passes.append(1) or real(*a))
    for tasks in (1, 7):
        got = fit_scatter(table(spark, points + 1e8, labels, tasks)).within
        assert np.allclose(got, wanted, rtol=1e-6)
    assert len(passes) == 2


def test_states_merge_in_any_order():
    rng = np.random.default_rng(11)
    points, labels = rng.normal(size=(90, 3)) + 1e6, rng.integers(0, 3, 90).astype(float)
    whole = ClassState(3, 10)
    whole.add(labels, points, slice(None))
    parts = []
    for cut in np.array_split(rng.permutation(90), 4):
        parts.append(ClassState(3, 10))
        parts[-1].add(labels[cut], points[cut], slice(None))
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        state = ClassState(3, 10)
        for i in order:
            state.take(parts[i].batch())
        assert state.rows == whole.rows
        assert np.allclose(state.within, whole.within)
        assert all(np.allclose(state.means[x], whole.means[x], rtol=1e-14) for x in whole.means)
