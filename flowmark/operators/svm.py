"""Linear support vector machines: fit, predict, convergence diagnostics, settings sweep."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.fixed_values import SWEEP_ITERATIONS, SWEEP_THRESHOLDS
from flowmark.functions.blocks import packed, vector_rows
from flowmark.functions.scalars import vector_width
from flowmark.operators.margins import Fit, Machine, View, fit_machines, with_scores
from flowmark.operators.metrics import (
    auroc,
    auroc_one_vs_rest,
    weighted_auroc,
)

DIAGNOSTIC_SCHEMA = (
    "max_iter int, submodel int, total_iterations int, objective_history array<double>,"
    " converged boolean, unavailable_reason string, gap double"
)


@dataclass(frozen=True)
class SvmModel:
    """One machine with its threshold for a binary task, otherwise one for each class."""

    machines: tuple[Machine, ...]
    fits: tuple[Fit, ...]
    threshold: float | None

    def after(self, iterations: int, threshold: float | None) -> SvmModel:
        """The model as it was after so many iterations, which has to be one of its snapshots."""
        fits = tuple(f.snapshots[iterations] for f in self.fits)
        return replace(self, fits=fits, threshold=None if self.threshold is None else threshold)


def missing_labels(train: DataFrame, labels: Sequence[float]) -> list[float]:
    """Declared labels without a training row; a model cannot be fitted soundly without them."""
    present = {row[0] for row in train.select("label").distinct().limit(len(labels) + 1).collect()}
    return [x for x in labels if x not in present]


def task_machines(kind: str, labels: Sequence[float], group: int, view: int, width: int) -> list[Machine]:
    """The machines of a task: of label 1 for a binary one, of every label otherwise."""
    positive = [1.0] if kind == "binary" else labels
    return [Machine(group, view, width, float(x)) for x in positive]


def fit_svm(
    train: DataFrame,
    kind: str,
    max_iter: int,
    threshold: float = 0.0,
    snapshots: Sequence[int] = (),
) -> SvmModel:
    """Linear SVM without regularisation for a binary task, one machine per class otherwise.

    All machines are fitted in the same passes over ``train``, at most ``max_iter`` and one before, which is read
    once and kept packed for them. Classes count from 0 to the highest label.
    """
    width = vector_width(train, "features")
    labels = [0.0, 1.0]
    if kind != "binary":
        highest = train.agg(F.max("label")).first()[0]
        labels = [float(x) for x in range(int(highest) + 1)]
    machines = task_machines(kind, labels, 0, 0, width)
    rows = packed(vector_rows(train)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = fit_machines(rows, {0: [View()]}, {0: width}, machines, max_iter, snapshots)
    finally:
        rows.unpersist()
    return SvmModel(tuple(machines), tuple(fits), threshold if kind == "binary" else None)


def predict(model: SvmModel, df: DataFrame) -> DataFrame:
    """Label, prediction and raw scores; other columns of ``df`` but the features are kept."""
    scored = with_scores(df, model.machines, model.fits).drop("features")
    return _judged(scored, F.lit(model.threshold) if model.threshold is not None else None)


def _judged(scored: DataFrame, threshold: Column | None) -> DataFrame:
    """Scores of both sides and the prediction by the threshold, or the class with the highest score without one."""
    if threshold is None:
        highest = F.array_position("scores", F.array_max("scores")) - 1
        return scored.withColumn("prediction", highest.cast("double"))
    score = F.col("scores")[0]
    return scored.withColumns(
        {"prediction": (score > threshold).cast("double"), "scores": F.array(-score, score)}
    )


def evaluate_auroc(
    predictions: DataFrame, labels: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """One AUROC per identity: of the attack score, or weighted over one-vs-rest scores."""
    if len(labels) == 2:
        return auroc(
            predictions, F.element_at("scores", -1), F.col("label") == float(labels[1]), by
        ).select(*by, "auroc")
    per_class = auroc_one_vs_rest(predictions, F.col("scores"), labels, by)
    return weighted_auroc(per_class, labels, by)


def diagnostic_rows(model: SvmModel, max_iter: int) -> list[tuple]:
    """How each machine got to its weights, in the order of :data:`DIAGNOSTIC_SCHEMA`."""
    return [
        (max_iter, number, fit.iterations, fit.history, fit.iterations < max_iter, "", fit.gap)
        for number, fit in enumerate(model.fits)
    ]


def diagnostics(spark: SparkSession, model: SvmModel, max_iter: int) -> DataFrame:
    """Convergence of each fitted machine as a table; its loss is at most ``gap`` above the least."""
    return spark.createDataFrame(diagnostic_rows(model, max_iter), DIAGNOSTIC_SCHEMA)


def at_threshold(predictions: DataFrame, threshold: float) -> DataFrame:
    """Binary predictions under another threshold of the raw score; nothing is fitted again."""
    return predictions.withColumn(
        "prediction", (F.element_at("scores", -1) > F.lit(threshold)).cast("double")
    )


def sweep(
    train: DataFrame,
    test: DataFrame,
    kind: str,
    iterations: Sequence[int] = SWEEP_ITERATIONS,
    thresholds: Sequence[float] = SWEEP_THRESHOLDS,
) -> tuple[DataFrame, list[tuple]]:
    """Predictions and diagnostic rows over a grid of iterations and thresholds.

    One fit at the largest number of iterations; smaller ones are its snapshots. Thresholds only move the cut
    on the raw score, and have no effect on the class with the highest score.
    """
    model = fit_svm(train, kind, max(iterations), 0.0, iterations)
    snapshots = [model.after(n, 0.0) for n in iterations]
    diagnosed = [row for n, own in zip(iterations, snapshots) for row in diagnostic_rows(own, n)]
    # the test rows are read once: every machine of every snapshot scores them side by side
    machines = [m for own in snapshots for m in own.machines]
    scored = with_scores(test, machines, [f for own in snapshots for f in own.fits]).drop("features")
    width = len(model.machines)
    setting = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("svm_max_iter"), F.lit(t).alias("svm_threshold"), F.lit(i * width + 1).alias("at")
                )
                for i, n in enumerate(iterations)
                for t in thresholds
            ]
        )
    )
    others = [c for c in scored.columns if c != "scores"]
    each = scored.select(setting.alias("__s"), *others, "scores").select(
        "__s.svm_max_iter", "__s.svm_threshold", *others, F.slice("scores", F.col("__s.at"), width).alias("scores")
    )
    return _judged(each, F.col("svm_threshold") if kind == "binary" else None), diagnosed
