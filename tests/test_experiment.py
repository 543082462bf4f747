import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowmark.operators.svm import (
    at_threshold,
    diagnostics,
    evaluate_auroc,
    fit_svm,
    missing_labels,
    predict,
    sweep,
)
from flowmark.operators.tasks import DatasetSpec, Protocol
from flowmark.plans.audit import audit_run
from flowmark.plans.experiment import RunConfig, run
from flowmark.sources.artifacts import publish_run


@pytest.fixture()
def points(spark):
    return spark.range(20).select(
        (F.col("id") % 2).cast("double").alias("label"),
        array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double"))).alias("features"),
    )


def test_diagnostics(spark, points):
    model = fit_svm(points, "binary", 5)
    row = diagnostics(spark, model, 5).first()
    assert row.max_iter == 5 and row.submodel == 0 and row.unavailable_reason == ""
    assert row.total_iterations > 0 and row.objective_history
    assert row.converged == (row.total_iterations < 5)
    three = points.withColumn("label", (F.col("label") + F.element_at(F.array(F.lit(0.0), F.lit(1.0)), 1)))
    many = three.union(three.limit(5).withColumn("label", F.lit(2.0)))
    assert diagnostics(spark, fit_svm(many, "multinomial", 3), 3).count() == 3


def test_missing_labels(points):
    assert missing_labels(points, [0.0, 1.0, 2.0]) == [2.0]


def test_sweep_equals_single_fits(points):
    predicted, report = sweep(points, points, "binary", (2, 5), (0.5, 0.0))
    assert len(report) == 2 and predicted.count() == 4 * points.count()
    for iterations in (2, 5):
        for threshold in (0.5, 0.0):
            alone = predict(fit_svm(points, "binary", iterations, threshold), points)
            own = predicted.filter((F.col("svm_max_iter") == iterations) & (F.col("svm_threshold") == threshold))
            assert sorted(r.prediction for r in own.collect()) == sorted(r.prediction for r in alone.collect())
            assert evaluate_auroc(own, [0.0, 1.0]).first() == evaluate_auroc(alone, [0.0, 1.0]).first()
    assert at_threshold(predicted, 1e9).filter("prediction = 1").isEmpty()


@pytest.fixture(scope="module")
def flows(spark):
    """Three classes that services and durations tell apart, and a rare one outside the tasks."""
    kind = F.col("id") % 3
    return spark.range(600).select(
        F.concat(F.lit("u"), "id").alias("uid"),
        F.when(F.col("id") == 0, "Other")
        .when(kind == 0, "none").when(kind == 1, "Scan It").otherwise("Discovery")
        .alias("label_tactic"),
        F.element_at(F.array(F.lit("dns"), F.lit("http"), F.lit("ssh")), (kind + 1).cast("int")).alias("service"),
        (kind * 10 + F.col("id") % 7).cast("double").alias("duration"),
        (F.col("id") % 5).cast("double").alias("bytes"),
        F.concat(F.lit("10.0.0."), F.col("id") % 30).alias("src_ip_zeek"),
    )


SPEC = DatasetSpec("toy", ("Scan It", "Discovery"))


def test_corrected_run(spark, flows, tmp_path):
    protocol = Protocol.resolve("corrected", svm_max_iter=8)
    out = run(flows, SPEC, protocol, RunConfig(cap=150, pca_grid=(2,), profile="development"))
    rows = {(r.task, r.preprocessing, r.k): r for r in out["metrics"].collect()}
    assert set(rows) == {
        *[(t, "minimal", None) for t in ("Scan_It", "Discovery", "Multinomial")],
        *[(t, "pca", 2) for t in ("Scan_It", "Discovery", "Multinomial")],
        ("Scan_It", "lda", 1), ("Discovery", "lda", 1), ("Multinomial", "lda", 1), ("Multinomial", "lda", 2),
    }
    assert rows["Scan_It", "minimal", None].accuracy == 1.0
    assert rows["Multinomial", "minimal", None].accuracy == 1.0
    assert rows["Scan_It", "minimal", None].auroc == 1.0
    assert rows["Multinomial", "lda", 2].evaluation_valid
    assert out["timings"].count() == len(rows)
    assert out["confusion"].count() == len(rows)
    nested = out["confusion"].filter("task = 'Scan_It' AND preprocessing = 'minimal'").first()
    assert nested.label_mapping == {"none": 0.0, "Scan It": 1.0}
    assert sum(map(sum, nested.matrix)) == rows["Scan_It", "minimal", None].test_rows
    assert out["variance"].filter("preprocessing = 'pca'").count() == 3 * 2
    counts = out["class_counts"].filter("task = 'Multinomial' AND stage = 'minimal'").groupBy("label_tactic").sum("n")
    assert {r[0]: r[1] for r in counts.collect()} == {"none": 150, "Scan It": 150, "Discovery": 150}
    policy = out["preprocessing"].first()
    assert "src_ip_zeek" not in policy.categorical_features and policy.fit_scope == "train-only"
    assert out["unseen_categories"].filter("column = 'service'").first().rows == 0

    base = publish_run(spark, out, str(tmp_path), "run", {"config": {"method": "corrected", "profile": "development"}})
    reference = out["metrics"].selectExpr(
        "1 AS reference_version", "5 AS table", "14 AS page", "dataset", "preprocessing", "task", "k",
        "'accuracy' AS metric", "accuracy - 0.02 AS paper_value", "'fraction' AS unit", "'valid' AS status", "'' AS note",
    )
    tables = audit_run(spark, base, reference)
    assert tables["audit_verdict"].first().n == len(rows) - out["metrics"].filter("collapse_flag").count()
    assert {r.grade for r in tables["paper_comparison"].collect()} <= {"Close", ""}
    assert tables["audit_timing_ranks"].count() == 3 * 5
    assert spark.read.csv(f"{base}/paper_comparison", header=True).count() == len(rows)


def test_paper_run_with_sweep(spark, flows):
    protocol = Protocol.resolve("paper-compatible", sensitivity_run=True, svm_max_iter=1)
    noise = flows.withColumn("service", F.lit("same")).withColumn("duration", F.lit(1.0)).drop("src_ip_zeek", "bytes")
    noise = noise.withColumn("x", F.expr("CAST(pmod(xxhash64(uid), 9) AS DOUBLE)"))
    skewed = noise.filter("label_tactic <> 'Discovery' OR CAST(substring(uid, 2) AS INT) % 20 = 0")
    config = RunConfig(
        stages=("minimal",), profile="full", diagnostic_sweep=True, sweep_iterations=(1, 2), repetitions=1
    )
    out = run(skewed, SPEC, protocol, config)
    assert out["preprocessing"].first().fit_scope == "train+test"
    collapsed = out["metrics"].filter("collapse_flag").count()
    assert collapsed >= 1
    assert out["diagnostic_sweeps"].count() == collapsed * 2 * 2
    assert "string_index" in out


def test_label_without_training_rows(spark, flows):
    protocol = Protocol.resolve("corrected", svm_max_iter=3)
    spec = DatasetSpec("toy", ("Scan It", "Never Seen"))
    out = run(flows, spec, protocol, RunConfig(stages=("minimal",)))
    rows = {r.task: r for r in out["metrics"].collect()}
    assert rows["Scan_It"].evaluation_valid
    assert not rows["Never_Seen"].evaluation_valid and not rows["Multinomial"].evaluation_valid
    assert {(r.task, r.missing_label) for r in out["not_fitted"].collect()} == {
        ("Never_Seen", 1.0),
        ("Multinomial", 2.0),
    }


def test_full_run_is_refused_on_inventory_problems(spark, flows):
    problems = spark.createDataFrame([("toy", "rows", "rows: expected 1, found 2")], "dataset string, problem string, message string")
    with pytest.raises(RuntimeError, match="expected 1, found 2"):
        run(flows, SPEC, Protocol.resolve("corrected"), RunConfig(profile="full"), problems)


def test_key_columns_are_no_features(spark, flows):
    renamed = flows.withColumnRenamed("uid", "flow_number")
    config = RunConfig(stages=("minimal",), key_cols=("flow_number",))
    out = run(renamed, SPEC, Protocol.resolve("corrected", svm_max_iter=2), config)
    for row in out["preprocessing"].collect():
        assert "flow_number" not in [*row.numeric_features, *row.categorical_features]


def test_null_keys_fall_back_on_all_columns(spark, flows):
    nulled = flows.withColumn("uid", F.lit(None).cast("string"))
    config = RunConfig(stages=("minimal",))
    out = run(nulled, SPEC, Protocol.resolve("corrected", svm_max_iter=2), config)
    sides = {r.split for r in out["class_counts"].select("split").distinct().collect()}
    assert sides == {"train", "test"}
