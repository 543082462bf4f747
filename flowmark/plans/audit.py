"""Audit of a run: its results against published cells, and the tables of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowmark.fixed_values import REFERENCE_VERSION
from flowmark.operators import compare as C
from flowmark.sources.artifacts import read_manifest, read_table, write_table
from flowmark.sources.published import errata, published_cells

UNKNOWN = "legacy/unknown"
PROTOCOL_FIELDS = (
    "split_strategy",
    "preprocessing_fit_scope",
    "feature_policy",
    "svm_max_iter",
    "svm_threshold",
    "minimal_scaling",
)

IDENTITY_SCHEMA = (
    "dataset string, task string, task_kind string, method string, profile string,"
    " preprocessing string, k int, engine string, execution_mode string, accelerator string,"
    " distributed boolean"
)
METRIC_SCHEMA = (
    f"{IDENTITY_SCHEMA}, accuracy double, weighted_precision double, weighted_recall double,"
    " weighted_f1 double, weighted_fpr double, macro_precision double, macro_recall double,"
    " macro_f1 double, attack_precision double, attack_recall double, attack_f1 double,"
    " attack_fpr double, per_class_fpr_json string, predicted_support_json string,"
    " test_rows bigint, collapse_flag boolean, collapse_reason string, evaluation_valid boolean,"
    " evaluation_warning string, auroc double"
)
VARIANCE_SCHEMA = (
    f"{IDENTITY_SCHEMA}, component int, explained_variance double, cumulative_variance double"
)
TIMING_SCHEMA = (
    f"{IDENTITY_SCHEMA}, repetition int, base_preprocessing_seconds double,"
    " dimensionality_reduction_seconds double, training_seconds double,"
    " prediction_seconds double, metric_seconds double, preprocessing_seconds double,"
    " evaluation_seconds double"
)


def protocol_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """Settings of a run by name; older manifests miss some."""
    protocol = manifest.get("protocol", {})
    config = manifest.get("config", {})
    rows = [
        ("method", config.get("method", "unknown")),
        ("profile", config.get("profile", "unknown")),
        ("protocol_version", protocol.get("protocol_version", manifest.get("manifest_version", 1))),
        *[(name, protocol.get(name, UNKNOWN)) for name in PROTOCOL_FIELDS],
        ("reference_version", REFERENCE_VERSION),
    ]
    return spark.createDataFrame(
        [(name, str(value)) for name, value in rows], "setting string, value string"
    )


def audit(
    reference: DataFrame,
    metrics: DataFrame,
    variance: DataFrame | None = None,
    timings: DataFrame | None = None,
    manifest: dict | None = None,
) -> dict[str, DataFrame]:
    """All tables of the audit and of the charts, by name."""
    spark = reference.sparkSession
    cells = C.compare(reference, metrics, variance, timings)
    tables = {
        "paper_comparison": cells,
        "audit_verdict": C.error_summary(cells),
        "audit_errors": C.error_by_group(cells),
        "audit_collapsed": C.collapsed_models(metrics),
        "audit_protocol": protocol_table(spark, manifest or {}),
        "audit_errata": errata(spark),
        "chart_best_accuracy": C.best_accuracy(metrics),
        "chart_accuracy_by_k": C.chart_accuracy_by_k(metrics),
        "chart_published": C.chart_published(cells),
    }
    if variance is not None:
        tables["chart_variance"] = C.chart_variance(variance)
    if timings is not None:
        tables["audit_timing_ranks"] = C.ranking_text(C.timing_ranks(timings))
        tables["chart_phases"] = C.chart_phases(timings)
    return tables


def audit_run(
    spark: SparkSession, base: str, reference: DataFrame | None = None, write: bool = True
) -> dict[str, DataFrame]:
    """Compare a published run folder with the reference and write the tables next to it."""
    manifest = read_manifest(spark, base)
    tables = audit(
        published_cells(spark) if reference is None else reference,
        read_table(spark, f"{base}/metrics", METRIC_SCHEMA),
        read_table(spark, f"{base}/variance", VARIANCE_SCHEMA),
        read_table(spark, f"{base}/timings", TIMING_SCHEMA),
        manifest,
    )
    if write:
        for name, table in tables.items():
            write_table(table, f"{base}/{name}")
    return tables
