"""Classification tasks as a table, and the protocol of a run."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.fixed_values import (
    BENIGN,
    EXPECTED_CLASS_ROWS,
    EXPECTED_FILES,
    EXPECTED_ROWS,
    METHOD_SETTINGS,
    PCA_GRID,
    SEED,
    TACTICS,
)
from flowmark.functions.durable import local_table

TASK_SCHEMA = "dataset string, task string, kind string, label_tactic string, label double"


@dataclass(frozen=True)
class DatasetSpec:
    """What a labelled dataset holds: its tactics and, if known, the expected inventory."""

    name: str
    tactics: tuple[str, ...]
    benign: str = BENIGN
    files: int | None = None
    rows: int | None = None
    class_rows: dict[str, int] = field(default_factory=dict)

    def tasks(self) -> list[tuple[str, str, tuple[str, ...]]]:
        """One binary task per tactic, then the multinomial task."""
        binary = [(t.replace(" ", "_"), "binary", (t,)) for t in self.tactics]
        return [*binary, ("Multinomial", "multinomial", self.tactics)]

    def label_mapping(self, task: str) -> dict[str, float]:
        """Class name to label: benign is 0.0, tactics count up in declared order."""
        for name, _, tactics in self.tasks():
            if name == task:
                return dict(zip((self.benign, *tactics), map(float, range(len(tactics) + 1))))
        raise KeyError(task)


STUDY_DATASETS = {
    name: DatasetSpec(
        name,
        TACTICS[name],
        files=EXPECTED_FILES[name],
        rows=EXPECTED_ROWS[name],
        class_rows=EXPECTED_CLASS_ROWS[name],
    )
    for name in TACTICS
}


def task_map(spark: SparkSession, specs: Iterable[DatasetSpec]) -> DataFrame:
    """One row per dataset, task and class of the task, with the label of the class."""
    rows = [
        (spec.name, task, kind, tactic, label)
        for spec in specs
        for task, kind, _ in spec.tasks()
        for tactic, label in spec.label_mapping(task).items()
    ]
    return local_table(spark, rows, TASK_SCHEMA)


def label_lookup(mapping: dict[str, float], column: Column) -> Column:
    """Literal map lookup; classes outside the map become null."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])[column]


def build_task_frame(df: DataFrame, mapping: dict[str, float], label_col: str = "label_tactic"):
    """Rows of one task with its ``label``; null and foreign classes are left out."""
    return df.filter(F.col(label_col).isin(*mapping)).withColumn(
        "label", label_lookup(mapping, F.col(label_col)).cast("double")
    )


def build_task_frames(
    df: DataFrame,
    specs: Sequence[DatasetSpec],
    label_col: str = "label_tactic",
    dataset_col: str | None = None,
) -> DataFrame:
    """All tasks in one scan: a row comes once per task it belongs to, with ``task`` and ``label``.

    The joined table has one row per declared class, so it is broadcast. ``dataset_col`` names
    the dataset of a row where several datasets are stacked.
    """
    lookup = task_map(df.sparkSession, specs).withColumnRenamed("label_tactic", "__class")
    condition = F.col(label_col) == F.col("__class")
    if dataset_col:
        lookup = lookup.withColumnRenamed("dataset", "__dataset")
        condition &= F.col(dataset_col) == F.col("__dataset")
    classes = sorted({c for spec in specs for c in (spec.benign, *spec.tactics)})
    return (
        df.filter(F.col(label_col).isin(classes))  # reaches the Parquet scan
        .join(F.broadcast(lookup), condition)
        .drop("__class", "__dataset")
    )


def task_labels(spark: SparkSession, specs: Sequence[DatasetSpec]) -> DataFrame:
    """Declared labels of each dataset and task as a sorted array."""
    return (
        task_map(spark, specs)
        .groupBy("dataset", "task")
        .agg(F.sort_array(F.collect_list("label")).alias("labels"))
    )


@dataclass(frozen=True)
class Protocol:
    """Resolved settings of a run."""

    method: str
    split_strategy: str
    preprocessing_fit_scope: str
    feature_policy: str
    svm_max_iter: int
    svm_threshold: float
    minimal_scaling: str
    seed: int = SEED
    sensitivity_run: bool = False
    protocol_version: int = 2

    @classmethod
    def resolve(
        cls, method: str, seed: int = SEED, sensitivity_run: bool = False, **overrides
    ) -> Protocol:
        """Defaults of ``method`` with overrides; a faithful run may only be changed knowingly."""
        settings = dict(METHOD_SETTINGS[method])
        given = {name: value for name, value in overrides.items() if value is not None}
        unknown = given.keys() - {
            "feature_policy",
            "svm_max_iter",
            "svm_threshold",
            "minimal_scaling",
        }
        if unknown:
            raise TypeError(f"cannot override {sorted(unknown)}")
        changed = sorted(name for name, value in given.items() if value != settings[name])
        if method == "paper-compatible" and changed and not sensitivity_run:
            raise ValueError(f"overriding {changed} needs sensitivity_run=True")
        return cls(
            method=method, seed=seed, sensitivity_run=sensitivity_run, **{**settings, **given}
        )

    @property
    def fit_on_all(self) -> bool:
        return self.preprocessing_fit_scope == "train+test"

    def scales(self, stage: str) -> bool:
        """Only the minimal stage may go unscaled."""
        return stage != "minimal" or self.minimal_scaling == "scaled"


def variants(stage: str, classes: int, dimension: int, grid: Sequence[int] = PCA_GRID) -> list:
    """Component counts a stage is evaluated at; ``None`` stands for unreduced features."""
    if stage == "minimal":
        return [None]
    if stage == "pca":
        return [k for k in grid if k <= dimension]
    if stage == "lda":
        return list(range(1, classes))
    raise ValueError(f"unknown stage {stage!r}")
