"""Every operator takes an empty table and keeps its schema."""

import pytest
from pyspark.sql import functions as F

from flowmark.functions.ordered import exact_medians
from flowmark.operators import compare as C
from flowmark.operators import metrics as M
from flowmark.operators import profile as P
from flowmark.operators import sampling as X
from flowmark.plans.audit import METRIC_SCHEMA, TIMING_SCHEMA, VARIANCE_SCHEMA, audit
from flowmark.sources.published import published_cells


@pytest.fixture()
def flows(spark):
    return spark.createDataFrame([], "uid string, label_tactic string, label double, x double")


def test_samples_and_counts(flows):
    counts = X.class_counts(flows, ["label_tactic"])
    table = X.quotas(counts, 0.5)
    assert table.columns == ["label_tactic", "n", "quota"] and table.isEmpty()
    assert X.quota_sample(flows, table, ["label_tactic"], ["uid"]).isEmpty()
    assert X.hash_split(flows, ["uid"]).isEmpty()


def test_categories(flows):
    assert P.category_index(flows, ["uid"]).isEmpty()
    unseen = P.unseen_categories(flows, flows, ["uid", "label_tactic"]).collect()
    assert {r.column: r.rows for r in unseen} == {"uid": 0, "label_tactic": 0}
    assert P.hash_load(flows, ["uid"]).first().load_factor == 0.0


def test_metrics(flows):
    scored = flows.withColumn("prediction", F.lit(0.0)).withColumn("scores", F.array("x", "x"))
    assert M.confusion(scored, [0, 1], ["uid"]).isEmpty()
    assert M.auroc(scored, F.col("x"), F.col("label") == 1, ["uid"]).isEmpty()
    alone = M.auroc(scored, F.col("x"), F.col("label") == 1).first()
    assert (alone.positives, alone.negatives, alone.auroc) == (0, 0, None)
    per_class = M.auroc_one_vs_rest(scored, F.col("scores"), [0, 1])
    assert M.weighted_auroc(per_class, [0, 1]).first().auroc is None


def test_medians(flows):
    out = exact_medians(flows, ["uid"], ["x"])
    assert out.columns == ["uid", "x"] and out.isEmpty()


def test_audit_of_a_run_without_results(spark):
    tables = audit(
        published_cells(spark),
        spark.createDataFrame([], METRIC_SCHEMA),
        spark.createDataFrame([], VARIANCE_SCHEMA),
        spark.createDataFrame([], TIMING_SCHEMA),
    )
    states = {r.comparison_status for r in tables["paper_comparison"].collect()}
    assert states == {"missing-run-result", "excluded-paper-erratum", "unmeasured-backend"}
    assert tables["audit_verdict"].first().n == 0
    for name in ("audit_errors", "audit_timing_ranks", "chart_variance", "chart_phases"):
        assert tables[name].isEmpty()


def test_every_audit_table_of_an_empty_comparison(spark):
    cells = C.compare(published_cells(spark), spark.createDataFrame([], METRIC_SCHEMA))
    assert cells.count() == 905 and C.chart_published(cells).isEmpty()
