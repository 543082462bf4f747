import random

import pytest
from pyspark.sql import functions as F

from flowmark.operators import metrics as M


def frame(spark, truth, guess, scores=None):
    rows = [
        (float(a), float(b), scores[i] if scores else None)
        for i, (a, b) in enumerate(zip(truth, guess))
    ]
    return spark.createDataFrame(rows, "label double, prediction double, scores array<double>")


def evaluate(spark, truth, guess, labels):
    table = M.confusion(frame(spark, truth, guess), labels)
    classes = M.per_class(table)
    matrix = {(r.label, r.prediction): r.n for r in table.collect()}
    ordered = [[matrix[float(a), float(p)] for p in labels] for a in labels]
    return M.summary(classes).first(), {r.label: r for r in classes.collect()}, ordered


def test_attack_and_weighted_views(spark):
    truth, guess = [0] * 5 + [1] * 3 + [0] * 2, [0] * 4 + [1] + [1] * 2 + [0] + [1, 0]
    total, classes, matrix = evaluate(spark, truth, guess, [0, 1])
    assert matrix == [[5, 2], [1, 2]]
    assert total.accuracy == 0.7
    assert total.attack_precision == 0.5
    assert total.attack_recall == pytest.approx(2 / 3)
    assert total.attack_fpr == pytest.approx(2 / 7)
    assert total.weighted_fpr == pytest.approx(0.7 * (1 / 3) + 0.3 * (2 / 7))
    assert classes[1.0].predicted_support == 4
    assert sum(r.support for r in classes.values()) == total.test_rows == 10
    assert total.predicted_support_json == '{"0.0":6,"1.0":4}'


def test_no_division_by_zero_and_collapse(spark):
    total, classes, _ = evaluate(spark, [1, 0, 2, 2, 0], [0, 0, 2, 2, 0], [0, 1, 2])
    assert classes[1.0].f1 == 0.0 and classes[1.0].precision == 0.0 and classes[1.0].predicted_support == 0
    assert classes[2.0].f1 == 1.0
    assert total.collapse_flag
    assert total.collapse_reason == "zero predictions or recall for supported labels: 1.0"
    assert total.evaluation_valid and total.evaluation_warning == ""


def test_missing_class_is_not_valid(spark):
    total, _, matrix = evaluate(spark, [0, 0, 0, 2], [0, 2, 0, 2], [0, 1, 2])
    assert matrix == [[2, 0, 1], [0, 0, 0], [0, 0, 1]]
    assert not total.evaluation_valid
    assert total.evaluation_warning == "no test support for labels: 1.0"
    assert not total.collapse_flag


def test_empty_predictions_and_foreign_labels(spark):
    total, _, matrix = evaluate(spark, [], [], [0, 1])
    assert matrix == [[0, 0], [0, 0]] and total.test_rows == 0 and total.accuracy == 0.0
    total, _, matrix = evaluate(spark, [0, 9, 1], [0, 0, 7], [0, 1])
    assert matrix == [[1, 0], [0, 0]]


def test_label_one_undeclared(spark):
    total, _, _ = evaluate(spark, [0, 2], [0, 2], [0, 2])
    assert total.attack_f1 is None and total.attack_fpr is None


def test_grouped_labels(spark):
    rows = [("a", 0.0, 0.0), ("a", 1.0, 0.0), ("b", 2.0, 2.0), ("b", 0.0, 1.0)]
    predictions = spark.createDataFrame(rows, "task string, label double, prediction double")
    labels = spark.createDataFrame(
        [("a", [0.0, 1.0]), ("b", [0.0, 1.0, 2.0])], "task string, labels array<double>"
    )
    table = M.confusion(predictions, labels, ["task"])
    assert {r.task: r["count"] for r in table.groupBy("task").count().collect()} == {"a": 4, "b": 9}
    nested = M.matrix_table(table, M.per_class(table, ["task"]), ["task"])
    got = {r.task: r for r in nested.collect()}
    assert got["a"].matrix == [[1, 0], [1, 0]]
    assert got["b"].matrix == [[0, 1, 0], [0, 0, 0], [0, 0, 1]]
    assert [c.label for c in got["b"].per_class] == [0.0, 1.0, 2.0]


def brute_auroc(pairs):
    pos = [s for s, p in pairs if p]
    neg = [s for s, p in pairs if not p]
    if not pos or not neg:
        return None
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("distinct", [1, 3, 40, 10_000])
def test_auroc_equals_pairwise_count(spark, distinct):
    rnd = random.Random(distinct)
    rows = [
        (g, rnd.randrange(distinct) / 7, rnd.random() < 0.3)
        for g in ("x", "y")
        for _ in range(400)
    ]
    rows += [("hot", 1.0, i % 3 == 0) for i in range(900)] + [("hot", 2.0, True)]
    rows += [("positives", 0.5, True), ("negatives", 0.5, False)]
    df = spark.createDataFrame(rows, "g string, score double, hit boolean").repartition(5)
    got = {r.g: r.auroc for r in M.auroc(df, F.col("score"), F.col("hit"), ["g"]).collect()}
    for g in {r[0] for r in rows}:
        wanted = brute_auroc([(s, p) for h, s, p in rows if h == g])
        assert got[g] == (wanted if wanted is None else pytest.approx(wanted, abs=1e-12))
    one = df.filter("g = 'x'")
    assert M.auroc(one, F.col("score"), F.col("hit")).first().auroc == pytest.approx(got["x"])


def test_multiclass_scores(spark):
    scores = [
        [3.0, 1.0, 0.0], [0.0, 3.0, 1.0], [0.0, 1.0, 3.0],
        [2.0, 1.0, 0.0], [0.0, 2.0, 1.0], [0.0, 1.0, 2.0],
    ]
    truth = [0, 1, 2, 0, 1, 2]
    predictions = frame(spark, truth, truth, scores)
    per_class = M.auroc_one_vs_rest(predictions, F.col("scores"), [0, 1, 2])
    assert M.weighted_auroc(per_class, [0, 1, 2]).first().auroc == 1.0
    # a machine that is missing leaves the average undefined
    short = predictions.withColumn("scores", F.slice("scores", 1, 2))
    per_class = M.auroc_one_vs_rest(short, F.col("scores"), [0, 1, 2])
    assert M.weighted_auroc(per_class, [0, 1, 2]).first().auroc is None


def test_weighted_auroc_weights_by_support(spark):
    rnd = random.Random(5)
    truth = [rnd.choice([0, 0, 0, 1, 2]) for _ in range(200)]
    scores = [[rnd.randrange(6) / 3 for _ in range(3)] for _ in truth]
    predictions = frame(spark, truth, truth, scores)
    wanted = sum(
        brute_auroc([(s[c], t == c) for s, t in zip(scores, truth)]) * truth.count(c)
        for c in range(3)
    ) / len(truth)
    per_class = M.auroc_one_vs_rest(predictions, F.col("scores"), [0, 1, 2])
    got = M.weighted_auroc(per_class, [0, 1, 2]).first().auroc
    assert got == pytest.approx(wanted, abs=1e-12)
