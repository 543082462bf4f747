"""Results against published cells: long forms, status, errors, grades, audit and chart tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmark.fixed_values import (
    CHART_PHASES,
    PHASES,
    QUALITY_METRICS,
    STATUS_COLLAPSED,
    STATUS_COMPARABLE,
    STATUS_CONTEXT,
    STATUS_EXCLUDED,
    STATUS_INVALID,
    STATUS_MISSING,
    STATUS_UNMEASURED,
    TIMING_SOURCES,
    VARIANCE_METRICS,
)
from flowmark.functions.durable import null_safe_join
from flowmark.functions.ordered import exact_medians
from flowmark.functions.scalars import grade

MODEL = ["dataset", "preprocessing", "task", "k"]
CELL = [*MODEL, "metric"]


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str):
    """One row per value column, nulls and NaN left out."""
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(ids), list(values), name, value
    )
    return long.filter(F.col(value).isNotNull() & ~F.isnan(value))


def long_metrics(metrics: DataFrame) -> DataFrame:
    """Quality metrics of each model as ``(model, metric, value)``."""
    present = [m for m in QUALITY_METRICS if m in metrics.columns]
    return unpivot(metrics, MODEL, present, "metric", "value")


def max_k_rows(variance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the fit with most components within each group."""
    largest = F.max("k").over(Window.partitionBy(*by))
    return (
        variance.withColumn("__largest", largest).filter(F.col("k") == F.col("__largest"))
    ).drop("__largest")


def long_variance(variance: DataFrame) -> DataFrame:
    """Variance of the largest fit as cells; the component takes the place of ``k``."""
    rows = max_k_rows(variance, ["dataset", "preprocessing", "task"])
    return unpivot(
        rows.withColumn("k", F.col("component").cast("int")), MODEL, VARIANCE_METRICS, "metric", "value"
    )


def long_timings(timings: DataFrame) -> DataFrame:
    """Median timing over repetitions under its published name."""
    medians = exact_medians(timings, MODEL, list(TIMING_SOURCES.values()))
    renamed = medians.select(*MODEL, *[F.col(c).alias(name) for name, c in TIMING_SOURCES.items()])
    return unpivot(renamed, MODEL, list(TIMING_SOURCES), "metric", "value")


def model_flags(metrics: DataFrame) -> DataFrame:
    """Whether a model collapsed, and whether its evaluation is valid."""
    collapsed = (
        F.bool_or(F.coalesce("collapse_flag", F.lit(False)))
        if "collapse_flag" in metrics.columns
        else F.lit(False)
    )
    valid = (
        F.bool_and(F.coalesce("evaluation_valid", F.lit(True)))
        if "evaluation_valid" in metrics.columns
        else F.lit(True)
    )
    return metrics.groupBy(*MODEL).agg(
        collapsed.alias("collapse_flag"), valid.alias("evaluation_valid")
    )


def compare(
    reference: DataFrame,
    metrics: DataFrame,
    variance: DataFrame | None = None,
    timings: DataFrame | None = None,
) -> DataFrame:
    """Every published cell with the reproduced value, its status, errors and grade.

    A model that occurs more than once counts with its greatest value of a metric; it has collapsed if any
    of its runs has, and is valid if all are.
    """
    values = long_metrics(metrics)
    if variance is not None:
        values = values.unionByName(long_variance(variance))
    if timings is not None:
        values = values.unionByName(long_timings(timings))
    # one value per cell, however often a model was run: the greatest
    values = values.groupBy(*CELL).agg(F.max("value").alias("reproduced_value"))
    joined = null_safe_join(reference, values, CELL, "left")
    joined = null_safe_join(joined, model_flags(metrics), MODEL, "left")
    return with_grade(
        with_errors(
            with_status(
                joined.withColumn(
                    "collapse_flag", F.coalesce("collapse_flag", F.lit(False))
                ).withColumn("evaluation_valid", F.coalesce("evaluation_valid", F.lit(True)))
            )
        )
    )


def with_status(cells: DataFrame) -> DataFrame:
    """Why a cell can or cannot be compared; the first reason that holds."""
    metric = F.col("metric")
    return cells.withColumn(
        "comparison_status",
        F.when(F.col("status") == "excluded", F.lit(STATUS_EXCLUDED))
        .when(metric.startswith("gpu_") | metric.contains("_mr_"), F.lit(STATUS_UNMEASURED))
        .when(F.col("reproduced_value").isNull(), F.lit(STATUS_MISSING))
        .when(~F.col("evaluation_valid"), F.lit(STATUS_INVALID))
        .when(
            F.col("collapse_flag") & (F.col("unit") == "fraction"), F.lit(STATUS_COLLAPSED)
        )
        .when(F.col("unit") == "seconds", F.lit(STATUS_CONTEXT))
        .otherwise(F.lit(STATUS_COMPARABLE)),
    )


def with_errors(cells: DataFrame) -> DataFrame:
    """Signed and absolute difference, and percentage points of fractions."""
    return (
        cells.withColumn("difference", F.col("reproduced_value") - F.col("paper_value"))
        .withColumn("absolute_difference", F.abs("difference"))
        .withColumn(
            "absolute_percentage_points",
            F.when(F.col("unit") == "fraction", F.col("absolute_difference") * 100),
        )
    )


def with_grade(cells: DataFrame) -> DataFrame:
    """Grade of comparable accuracies, empty otherwise."""
    graded = (F.col("metric") == "accuracy") & (F.col("comparison_status") == STATUS_COMPARABLE)
    return cells.withColumn(
        "grade", F.when(graded, grade(F.col("absolute_percentage_points"))).otherwise(F.lit(""))
    )


def _comparable(cells: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return cells.filter(
        F.col("metric").isin(list(metrics)) & (F.col("comparison_status") == STATUS_COMPARABLE)
    )


def error_summary(cells: DataFrame) -> DataFrame:
    """Verdict over comparable accuracies: size of the errors and shares within 1, 3 and 5 points.

    The rows are published cells, so their number is bounded by the reference table.
    """
    error = F.col("absolute_percentage_points")
    return _comparable(cells, ["accuracy"]).agg(
        F.count(F.lit(1)).alias("n"),
        F.median(error).alias("median_error"),
        F.avg(error).alias("mean_error"),
        *[
            F.avg(F.when(error <= bound, 1.0).otherwise(0.0)).alias(f"within_{bound}")
            for bound in (1, 3, 5)
        ],
    )


def error_by_group(cells: DataFrame) -> DataFrame:
    """Errors per dataset, method and task for accuracy, per dataset and method for variance."""
    error = F.col("absolute_percentage_points")
    part = F.when(F.col("metric") == "accuracy", "accuracy").otherwise("variance")
    wanted = _comparable(cells, ["accuracy", *VARIANCE_METRICS]).select(
        part.alias("part"), "dataset", "preprocessing", "task", error.alias("error")
    )
    sets = wanted.groupingSets(
        [["part", "dataset", "preprocessing", "task"], ["part", "dataset", "preprocessing"]],
        "part", "dataset", "preprocessing", "task",
    ).agg(
        F.grouping("task").alias("__whole"),
        F.count(F.lit(1)).alias("n"),
        F.median("error").alias("median_error"),
        F.avg("error").alias("mean_error"),
    )
    return sets.filter((F.col("part") == "variance") == (F.col("__whole") == 1)).drop("__whole")


def phase_medians(timings: DataFrame, phases: Sequence[str] = PHASES) -> DataFrame:
    """Median seconds of each phase per dataset, task and method."""
    present = [p for p in phases if p in timings.columns]
    return exact_medians(timings, ["dataset", "task", "preprocessing"], present)


def timing_ranks(timings: DataFrame, phases: Sequence[str] = PHASES) -> DataFrame:
    """Methods from fastest to slowest per dataset, task and phase.

    Only tasks on which at least two methods were measured are ranked.
    """
    present = [p for p in phases if p in timings.columns]
    long = unpivot(
        phase_medians(timings, present),
        ["dataset", "task", "preprocessing"],
        present,
        "phase",
        "seconds",
    )
    task = Window.partitionBy("dataset", "task")
    order = Window.partitionBy("dataset", "task", "phase").orderBy("seconds")
    return (
        long.withColumn("__methods", F.size(F.collect_set("preprocessing").over(task)))
        .filter(F.col("__methods") >= 2)
        .withColumn("rank", F.rank().over(order))
        .drop("__methods")
    )


def ranking_text(ranks: DataFrame) -> DataFrame:
    """One line per dataset, task and phase that lists methods from fastest to slowest."""
    item = F.struct("seconds", "preprocessing")
    return ranks.groupBy("dataset", "task", "phase").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(item)),
                lambda x: F.format_string("%s (%.3fs)", x["preprocessing"], x["seconds"]),
            ),
            " → ",
        ).alias("fastest_to_slowest")
    )


def timing_rows(measured: DataFrame) -> DataFrame:
    """Total preprocessing and evaluation seconds from their measured parts."""
    return measured.withColumn(
        "preprocessing_seconds",
        F.col("base_preprocessing_seconds") + F.col("dimensionality_reduction_seconds"),
    ).withColumn("evaluation_seconds", F.col("prediction_seconds") + F.col("metric_seconds"))


def best_accuracy(metrics: DataFrame) -> DataFrame:
    """Best accuracy per task and method among models that did not collapse.

    Datasets with a single method have nothing to compare and are left out; ``excluded`` is the
    number of collapsed models of the dataset.
    """
    dataset = Window.partitionBy("dataset")
    sound = ~F.coalesce(F.col("collapse_flag"), F.lit(False))
    best = metrics.groupBy("dataset", "task", "preprocessing").agg(
        F.max(F.when(sound, F.col("accuracy"))).alias("accuracy"),
        F.count_if(sound).alias("__sound"),
        F.count_if(~sound).alias("__collapsed"),
    )
    return (
        best.withColumn("excluded", F.sum("__collapsed").over(dataset))
        .filter(F.col("__sound") > 0)
        .withColumn("__methods", F.size(F.collect_set("preprocessing").over(dataset)))
        .filter(F.col("__methods") > 1)
        .select("dataset", "task", "preprocessing", "accuracy", "excluded")
    )


def chart_counts(classes: DataFrame) -> DataFrame:
    """Class counts per dataset, smallest first."""
    return classes.orderBy("dataset", "n", "label_tactic")


def chart_accuracy_by_k(metrics: DataFrame) -> DataFrame:
    """Accuracy over the number of components, collapsed models marked."""
    return metrics.filter(
        F.col("preprocessing").isin("pca", "lda") & F.col("k").isNotNull()
    ).select("dataset", "preprocessing", "task", "k", "accuracy", "collapse_flag")


def chart_published(cells: DataFrame) -> DataFrame:
    """Published and reproduced accuracy per model in long form."""
    shown = cells.filter(
        (F.col("metric") == "accuracy")
        & F.col("comparison_status").isin(STATUS_COMPARABLE, STATUS_COLLAPSED)
    )
    identity = F.concat_ws(
        " / ",
        "task",
        "preprocessing",
        F.concat(F.lit("k="), F.coalesce(F.col("k").cast("string"), F.lit("n/a"))),
    )
    return unpivot(
        shown.withColumn("identity", identity),
        ["dataset", "identity", "collapse_flag"],
        ["paper_value", "reproduced_value"],
        "source",
        "accuracy",
    )


def chart_variance(variance: DataFrame) -> DataFrame:
    """Explained and cumulative variance of the largest fit per dataset, method and task."""
    return max_k_rows(variance, ["dataset", "preprocessing", "task"]).select(
        "dataset", "preprocessing", "task", "component", *VARIANCE_METRICS
    )


def chart_phases(timings: DataFrame) -> DataFrame:
    """Median seconds of the charted phases in long form."""
    return unpivot(
        phase_medians(timings, CHART_PHASES),
        ["dataset", "task", "preprocessing"],
        CHART_PHASES,
        "phase",
        "seconds",
    )


def collapsed_models(metrics: DataFrame) -> DataFrame:
    """Models flagged as collapsed and why."""
    return metrics.filter("collapse_flag").select(
        "dataset", "task", "preprocessing", F.coalesce(F.col("k").cast("string"), F.lit("n/a")).alias("k"),
        "collapse_reason",
    )
