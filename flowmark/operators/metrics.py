"""Confusion counts, the metrics that follow from them, and exact AUROC.

Tables are long and grouped by any identity columns ``by``, so all tasks, variants and runs are
evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmark.fixed_values import COLLAPSE_TEXT, NO_SUPPORT_TEXT
from flowmark.functions.durable import null_safe_join
from flowmark.functions.ordered import PART, by_range
from flowmark.functions.scalars import ratio


def _label_array(labels: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in labels])


def _with_labels(df: DataFrame, labels: Sequence[float] | DataFrame, by: Sequence[str]):
    """Add the declared labels: one list for all rows, or a table of lists per identity."""
    if not isinstance(labels, DataFrame):
        return df.withColumn("__labels", _label_array(labels))
    on = [c for c in labels.columns if c != "labels"]
    return null_safe_join(df, labels.withColumnRenamed("labels", "__labels"), on)


def confusion(
    predictions: DataFrame,
    labels: Sequence[float] | DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """Rows per declared label and prediction, zeros included.

    Labels outside the declared ones do not count. The predictions are counted before anything
    is joined or filled in, so only the counts are shuffled.
    """
    counted = predictions.groupBy(
        *by,
        F.col(label).cast("double").alias("label"),
        F.col(prediction).cast("double").alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("n"))
    declared = _with_labels(counted, labels, by).filter(
        F.array_contains("__labels", F.col("label"))
        & F.array_contains("__labels", F.col("prediction"))
    )
    cell = F.struct("label", "prediction", "n")
    zeros = F.flatten(
        F.transform(
            "__labels",
            lambda a: F.transform(
                F.col("__labels"),
                lambda p: F.struct(
                    a.alias("label"), p.alias("prediction"), F.lit(0).cast("bigint").alias("n")
                ),
            ),
        )
    )
    listed = declared.groupBy(*by, "__labels").agg(F.collect_list(cell).alias("__cells"))
    if not by and not isinstance(labels, DataFrame):  # an empty table has its zeros too
        listed = declared.agg(F.collect_list(cell).alias("__cells")).withColumn(
            "__labels", _label_array(labels)
        )
    return (
        listed.select(*by, F.explode(F.concat("__cells", zeros)).alias("__c"))
        .select(*by, "__c.*")
        .groupBy(*by, "label", "prediction")
        .agg(F.sum("n").alias("n"))
    )


def per_class(confusion_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, false-positive rate and supports of every label."""
    nothing = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(nothing)
    roles = F.explode(
        F.array(
            F.struct(
                F.col("label"), F.col("n").alias("s"), nothing.alias("p"), hit.alias("tp")
            ),
            F.struct(
                F.col("prediction").alias("label"),
                nothing.alias("s"),
                F.col("n").alias("p"),
                nothing.alias("tp"),
            ),
        )
    )
    sums = (
        confusion_table.select(*by, roles.alias("__r"))
        .select(*by, "__r.*")
        .groupBy(*by, "label")
        .agg(
            F.sum("s").alias("support"),
            F.sum("p").alias("predicted_support"),
            F.sum("tp").alias("tp"),
        )
    )
    everything = Window.partitionBy(*(list(by) or [F.lit(0)]))
    precision, recall = F.col("precision"), F.col("recall")
    return (
        sums.withColumn("__total", F.sum("support").over(everything))
        .withColumn("fp", F.col("predicted_support") - F.col("tp"))
        .withColumn("fn", F.col("support") - F.col("tp"))
        .withColumn("tn", F.col("__total") - F.col("tp") - F.col("fp") - F.col("fn"))
        .withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", ratio(2 * precision * recall, precision + recall))
        .withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
        .select(
            *by, "label", "precision", "recall", "f1", "fpr", "support", "predicted_support",
            "tp", "fp", "fn", "tn",
        )
    )


def summary(per_class_table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per identity: weighted, macro and attack-class metrics, collapse and validity."""
    total = F.greatest(F.sum("support"), F.lit(1))
    attack = F.col("label") == 1.0
    collapsed = (F.col("support") > 0) & (
        (F.col("predicted_support") == 0) | (F.col("recall") == 0.0)
    )

    def weighted(name: str) -> Column:
        return (F.sum(F.col(name) * F.col("support")) / total).alias(f"weighted_{name}")

    def as_json(name: str) -> Column:
        entry = F.struct(F.col("label").cast("string").alias("key"), F.col(name).alias("value"))
        return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))))

    def label_list(condition: Column) -> Column:
        return F.transform(
            F.array_sort(F.collect_list(F.when(condition, F.col("label")))),
            lambda x: x.cast("string"),
        )

    def sentence(text: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(text), F.array_join(names, ", "))).otherwise(
            F.lit("")
        )

    return (
        per_class_table.groupBy(*by)
        .agg(
            (F.sum("tp") / total).alias("accuracy"),
            weighted("precision"),
            weighted("recall"),
            weighted("f1"),
            weighted("fpr"),
            F.avg("precision").alias("macro_precision"),
            F.avg("recall").alias("macro_recall"),
            F.avg("f1").alias("macro_f1"),
            *[
                F.max(F.when(attack, F.col(m))).alias(f"attack_{m}")
                for m in ("precision", "recall", "f1", "fpr")
            ],
            as_json("fpr").alias("per_class_fpr_json"),
            as_json("predicted_support").alias("predicted_support_json"),
            label_list(collapsed).alias("__collapsed"),
            label_list(F.col("support") == 0).alias("__missing"),
            F.sum("support").alias("test_rows"),
        )
        .withColumn("collapse_flag", F.size("__collapsed") > 0)
        .withColumn("collapse_reason", sentence(COLLAPSE_TEXT, F.col("__collapsed")))
        .withColumn("evaluation_valid", F.size("__missing") == 0)
        .withColumn("evaluation_warning", sentence(NO_SUPPORT_TEXT, F.col("__missing")))
        .drop("__collapsed", "__missing")
    )


def _auroc(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC of ``(by, __score, __positive)`` rows from rank sums, ties at half weight.

    Scores are counted first, so a score shared by many rows is one row. The distinct scores are
    range partitioned; each range ranks its own scores, and what lies below a range is added
    from one total per range.
    """
    by = list(by)
    # a row without a label is neither positive nor negative
    counted = scored.filter(F.col("__positive").isNotNull()).groupBy(*by, "__score").agg(
        F.sum(F.when(F.col("__positive"), 1).otherwise(0)).alias("__pos"),
        F.sum(F.when(F.col("__positive"), 0).otherwise(1)).alias("__neg"),
    )
    below = (
        Window.partitionBy(*by, PART)
        .orderBy("__score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # counts are multiplied as doubles: their product may pass 64 bits
    wins = F.col("__pos").cast("double") * (F.col("__below") + F.col("__neg") / 2)
    ranges = (
        by_range(counted, *by, "__score")
        .withColumn("__below", F.coalesce(F.sum("__neg").over(below), F.lit(0)))
        .groupBy(*by, PART)
        .agg(
            F.sum(wins).alias("__wins"),
            F.sum("__pos").alias("__pos"),
            F.sum("__neg").alias("__neg"),
        )
    )
    lower = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranges.withColumn("__lower", F.coalesce(F.sum("__neg").over(lower), F.lit(0)))
        .groupBy(*by)
        .agg(
            F.sum(F.col("__wins") + F.col("__pos").cast("double") * F.col("__lower")).alias("__w"),
            F.coalesce(F.sum("__pos"), F.lit(0)).alias("positives"),
            F.coalesce(F.sum("__neg"), F.lit(0)).alias("negatives"),
        )
        .withColumn(
            "auroc",
            F.when(
                (F.col("positives") > 0) & (F.col("negatives") > 0),
                F.col("__w") / (F.col("positives").cast("double") * F.col("negatives")),
            ),
        )
        .drop("__w")
    )


def auroc(
    predictions: DataFrame, score: Column, positive: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Exact AUROC per identity; null where only one side has rows."""
    return _auroc(
        predictions.select(*by, score.cast("double").alias("__score"), positive.alias("__positive")),
        by,
    )


def auroc_one_vs_rest(
    predictions: DataFrame,
    scores: Column,
    labels: Sequence[float],
    by: Sequence[str] = (),
    label: str = "label",
) -> DataFrame:
    """AUROC of every class against the rest, and each class's support.

    ``scores`` is an array with one score per declared label.
    """
    name = F.element_at(_label_array(labels), F.col("__at") + 1)
    exploded = (
        predictions.select(*by, F.col(label).alias("__label"), F.posexplode(scores))
        .withColumnRenamed("pos", "__at")
        .filter(F.col("__at") < len(labels))
        .select(
            *by,
            name.alias("class_label"),
            F.col("col").cast("double").alias("__score"),
            (F.col("__label") == name).alias("__positive"),
        )
    )
    return _auroc(exploded, [*by, "class_label"])


def weighted_auroc(
    class_auroc: DataFrame, labels: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Support-weighted mean of class AUROCs; null if a class is undefined or has no score."""
    weight = F.col("positives")
    return class_auroc.groupBy(*by).agg(
        F.when(
            (F.count("auroc") == len(labels)),
            F.sum(F.col("auroc") * weight) / F.sum(weight),
        ).alias("auroc")
    )


def matrix_table(
    confusion_table: DataFrame, per_class_table: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Nested form of a result: dense matrix in label order and the per-class records."""
    rows = (
        confusion_table.groupBy(*by, "label")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("prediction", "n"))), lambda c: c["n"]
            ).alias("__row")
        )
        .groupBy(*by)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("label", "__row"))), lambda c: c["__row"]
            ).alias("matrix")
        )
    )
    record = F.struct(
        "label", "precision", "recall", "f1", "fpr", "support", "predicted_support"
    )
    classes = per_class_table.groupBy(*by).agg(
        F.array_sort(F.collect_list(record)).alias("per_class")
    )
    return null_safe_join(rows, classes, by)
