import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowmark.fixed_values import DATASET_2022
from flowmark.functions.ordered import exact_medians, global_index
from flowmark.functions.scalars import grade
from flowmark.operators import compare as C
from flowmark.plans.audit import audit
from flowmark.sources.published import published_cells

D22 = DATASET_2022


def metrics_table(spark, rows):
    """Rows of (task, preprocessing, k, accuracy, collapsed, valid)."""
    return spark.createDataFrame(
        [(D22, *row, "why" if row[4] else "") for row in rows],
        "dataset string, task string, preprocessing string, k int, accuracy double,"
        " collapse_flag boolean, evaluation_valid boolean, collapse_reason string",
    )


def test_grades_have_inclusive_bounds(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,), (5.01,)], "e double")
    got = [r[0] for r in df.select(grade(F.col("e"))).collect()]
    assert got == ["Excellent", "Close", "Directional", "Divergent"]


def test_published_baseline_stays_close(spark):
    metrics = metrics_table(
        spark,
        [
            ("Reconnaissance", "minimal", None, 1.0, False, True),
            ("Discovery", "minimal", None, 0.99987, False, True),
            ("Multinomial", "minimal", None, 0.99977, False, True),
        ],
    )
    cells = C.compare(published_cells(spark), metrics)
    assert cells.count() == 905
    verdict = C.error_summary(cells).first()
    assert verdict.n == 3 and verdict.mean_error <= 0.10 and verdict.within_1 == 1.0
    best = cells.filter("table = 5 AND task = 'Reconnaissance' AND metric = 'accuracy'").first()
    assert (best.comparison_status, best.grade) == ("comparable", "Excellent")
    missing = cells.filter("table = 5 AND metric = 'auroc'").first()
    assert (missing.comparison_status, missing.grade) == ("missing-run-result", "")


def test_every_status(spark):
    metrics = metrics_table(
        spark,
        [
            ("Reconnaissance", "pca", 2, 0.95, False, True),
            ("Reconnaissance", "pca", 3, 0.95, True, True),
            ("Discovery", "pca", 2, 0.95, True, False),
            ("Multinomial", "minimal", None, 0.95, False, True),
        ],
    ).withColumn("weighted_f1", F.lit(0.9))
    variance = spark.createDataFrame(
        [(D22, "Reconnaissance", "pca", k, c, 0.1 * c, 0.1 * c) for k in (2, 3) for c in range(1, k + 1)],
        "dataset string, task string, preprocessing string, k int, component int,"
        " explained_variance double, cumulative_variance double",
    ).withColumn("explained_variance", F.col("explained_variance") * F.col("k"))
    timings = spark.createDataFrame(
        [(D22, "Reconnaissance", "pca", 2, float(s)) for s in (1, 2, 4, 9)],
        "dataset string, task string, preprocessing string, k int, preprocessing_seconds double",
    ).selectExpr("*", "preprocessing_seconds + 1 AS training_seconds", "CAST(NULL AS DOUBLE) AS evaluation_seconds")
    cells = C.compare(published_cells(spark), metrics, variance, timings)
    assert cells.count() == 905
    seen = {
        (r.table, r.task, r.k, r.metric): (r.comparison_status, r.reproduced_value)
        for r in cells.filter(F.col("dataset") == D22).collect()
    }
    assert seen[6, "Reconnaissance", 2, "accuracy"] == ("comparable", 0.95)
    assert seen[6, "Reconnaissance", 3, "accuracy"] == ("collapsed-run-result", 0.95)
    assert seen[6, "Discovery", 2, "accuracy"] == ("invalid-run-result", 0.95)
    assert seen[6, "Reconnaissance", 5, "weighted_f1"][0] == "excluded-paper-erratum"
    assert seen[5, "Multinomial", None, "weighted_f1"] == ("comparable", 0.9)
    # variance cells take the component for k, and the values of the largest fit
    assert seen[7, "Reconnaissance", 1, "explained_variance"] == ("comparable", pytest.approx(0.3))
    assert seen[7, "Reconnaissance", 3, "explained_variance"][0] == "collapsed-run-result"
    assert seen[16, "Reconnaissance", 2, "preprocessing_seconds"] == ("context-only-hardware-mismatch", 3.0)
    assert seen[16, "Reconnaissance", 2, "cpu_training_seconds"][1] == 4.0
    assert seen[16, "Reconnaissance", 2, "cpu_testing_seconds"] == ("missing-run-result", None)
    assert seen[16, "Reconnaissance", 2, "gpu_training_seconds"][0] == "unmeasured-backend"
    assert seen[18, "Discovery", 1, "cpu_mr_training_seconds"][0] == "unmeasured-backend"
    groups = {(r.part, r.preprocessing, r.task): r for r in C.error_by_group(cells).collect()}
    assert groups["accuracy", "pca", "Reconnaissance"].n == 1
    assert groups["variance", "pca", None].n == 2 + 2
    tables = audit(published_cells(spark), metrics, variance, timings, {"config": {"method": "m"}})
    assert tables["audit_collapsed"].count() == 2
    assert ("method", "m") in [tuple(r) for r in tables["audit_protocol"].collect()]
    chart = tables["chart_published"].filter("identity = 'Multinomial / minimal / k=n/a'")
    assert {r.source for r in chart.collect()} == {"paper_value", "reproduced_value"}
    assert {r.component for r in tables["chart_variance"].collect()} == {1, 2, 3}


def test_timing_medians_and_ranks(spark):
    rows = [("d", "t", m, r, s + r) for m, s in (("pca", 5.0), ("lda", 2.0)) for r in range(4)]
    rows += [("d", "alone", "pca", 0, 1.0)]
    timings = spark.createDataFrame(
        rows, "dataset string, task string, preprocessing string, repetition int, training_seconds double"
    )
    ranks = C.timing_ranks(timings)
    assert [(r.preprocessing, r["rank"], r.seconds) for r in ranks.orderBy("rank").collect()] == [
        ("lda", 1, 3.5),
        ("pca", 2, 6.5),
    ]
    assert C.ranking_text(ranks).first().fastest_to_slowest == "lda (3.500s) → pca (6.500s)"
    built = C.timing_rows(
        spark.createDataFrame(
            [(1.0, 2.0, 3.0, 4.0)],
            "base_preprocessing_seconds double, dimensionality_reduction_seconds double,"
            " prediction_seconds double, metric_seconds double",
        )
    ).first()
    assert (built.preprocessing_seconds, built.evaluation_seconds) == (3.0, 7.0)


def test_best_accuracy(spark):
    metrics = metrics_table(
        spark,
        [
            ("t", "pca", 2, 0.8, False, True),
            ("t", "pca", 3, 0.99, True, True),
            ("t", "minimal", None, 0.7, False, True),
        ],
    )
    got = {r.preprocessing: (r.accuracy, r.excluded) for r in C.best_accuracy(metrics).collect()}
    assert got == {"pca": (0.8, 1), "minimal": (0.7, 1)}
    assert C.best_accuracy(metrics.filter("k = 2")).isEmpty()
    by_k = C.chart_accuracy_by_k(metrics).collect()
    assert {(r.k, r.collapse_flag) for r in by_k} == {(2, False), (3, True)}


@pytest.mark.parametrize("sketch", [10_000, 100])
def test_exact_medians(spark, monkeypatch, sketch):
    monkeypatch.setattr("flowmark.functions.ordered.SKETCH", sketch)
    rnd = random.Random(1)
    rows = [
        (rnd.choice(["a", "b", None]), rnd.randrange(50) / 3, rnd.choice([None, float("nan"), 1.0, 2.0]))
        for _ in range(501)
    ]
    rows += [("hot", 7.0, None)] * 400 + [("hot", 1.0, None)] * 3
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    got = {r.g: r for r in exact_medians(df, ["g"], ["x", "y"]).collect()}
    for g in {r[0] for r in rows}:
        assert got[g].x == pytest.approx(statistics.median(x for h, x, _ in rows if h == g))
    for g in ("a", "b", None):
        own = [y for h, _, y in rows if h == g and y is not None and y == y]
        assert got[g].y == statistics.median(own)
    assert got["hot"].y is None


def test_global_index(spark):
    df = spark.range(3000).selectExpr("id % 7 AS a", "id AS b").repartition(9)
    out = global_index(df, [F.desc("a"), F.col("b")], "i").orderBy("i").collect()
    assert [r.i for r in out] == list(range(3000))
    assert [(r.a, r.b) for r in out] == sorted(((r.a, r.b) for r in out), key=lambda x: (-x[0], x[1]))


def test_side_tables_beyond_the_limit_are_joined_by_shuffle(spark):
    from flowmark.functions.durable import null_safe_join, side_table

    small = spark.range(5).selectExpr("id AS k", "id * 2 AS v")
    for limit, broadcast in ((5, True), (4, False)):
        side = side_table(small, limit)
        joined = null_safe_join(spark.range(3).withColumnRenamed("id", "k"), side, ["k"])
        assert sorted(map(tuple, joined.collect())) == [(0, 0), (1, 2), (2, 4)]
        plan = joined._jdf.queryExecution().toString()
        assert ("ResolvedHint (strategy=broadcast)" in plan) == broadcast
