import pytest

from flowmark.fixed_values import PCA_GRID
from flowmark.operators.tasks import (
    STUDY_DATASETS,
    DatasetSpec,
    Protocol,
    build_task_frame,
    build_task_frames,
    task_labels,
    task_map,
    variants,
)


def test_component_grid():
    assert PCA_GRID == (2, 3, 5, 10, 11)
    assert variants("pca", 3, 6) == [2, 3, 5]
    assert variants("lda", 2, 99) == [1]
    assert variants("lda", 6, 99) == [1, 2, 3, 4, 5]
    assert variants("minimal", 2, 3) == [None]


@pytest.mark.parametrize("spec", STUDY_DATASETS.values(), ids=lambda s: s.name)
def test_benign_is_zero_and_attack_is_one(spec):
    tasks = spec.tasks()
    for name, kind, tactics in tasks[:-1]:
        mapping = spec.label_mapping(name)
        assert kind == "binary" and " " not in name
        assert mapping == {"none": 0.0, tactics[0]: 1.0}
    assert len(spec.label_mapping("Multinomial")) == len(spec.tactics) + 1


def test_protocol_defaults_and_overrides():
    paper = Protocol.resolve("paper-compatible")
    assert (paper.svm_max_iter, paper.svm_threshold) == (10, 0.00001)
    assert paper.fit_on_all and paper.feature_policy == "legacy-ordinal"
    corrected = Protocol.resolve("corrected", svm_max_iter=7, minimal_scaling="unscaled")
    assert (corrected.svm_max_iter, corrected.svm_threshold) == (7, 0.0)
    assert not corrected.fit_on_all
    assert not corrected.scales("minimal") and corrected.scales("pca")
    with pytest.raises(ValueError, match="sensitivity_run"):
        Protocol.resolve("paper-compatible", svm_max_iter=50)
    assert Protocol.resolve("paper-compatible", svm_max_iter=10).svm_max_iter == 10
    assert Protocol.resolve("paper-compatible", sensitivity_run=True, svm_max_iter=50)


def test_task_frames_agree(spark):
    spec = DatasetSpec("d", ("Big Scan", "Discovery"))
    rows = [(1, "none"), (2, "Big Scan"), (3, "Discovery"), (4, "Other"), (5, None)]
    flows = spark.createDataFrame(rows, "id int, label_tactic string")
    stacked = build_task_frames(flows, [spec])
    for task, _, _ in spec.tasks():
        single = build_task_frame(flows, spec.label_mapping(task))
        got = stacked.filter(stacked.task == task).select("id", "label").collect()
        assert sorted(got) == sorted(single.select("id", "label").collect())
    assert {r.task for r in task_map(spark, [spec]).collect()} == {
        "Big_Scan",
        "Discovery",
        "Multinomial",
    }
    labels = {r.task: r.labels for r in task_labels(spark, [spec]).collect()}
    assert labels["Multinomial"] == [0.0, 1.0, 2.0]


def test_stacked_datasets_keep_their_own_labels(spark):
    one, two = DatasetSpec("one", ("A", "B")), DatasetSpec("two", ("B",))
    rows = [("one", "B"), ("two", "B"), ("two", "A")]
    flows = spark.createDataFrame(rows, "ds string, label_tactic string")
    out = build_task_frames(flows, [one, two], dataset_col="ds")
    multi = {(r.ds, r.label_tactic): r.label for r in out.filter("task = 'Multinomial'").collect()}
    assert multi == {("one", "B"): 2.0, ("two", "B"): 1.0}
