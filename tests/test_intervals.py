"""AUROC intervals and membership filters against the exact operators."""

import random

import pytest
from pyspark.sql import functions as F

from flowmark.operators import auroc_state as A
from flowmark.operators import profile
from flowmark.operators.metrics import auroc
from flowmark.operators.profile import unseen_by_filter, unseen_categories


def scored(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        positive = rng.random() < 0.3
        smooth = rng.gauss(0.4 if positive else 0, 1)
        # a third of all scores are one number, others come from a long tail
        tied = 0.5 if rng.random() < 0.35 else round(smooth, 1) if rng.random() < 0.5 else smooth**3 * 1e6
        rows += [("smooth", positive, smooth), ("tied", positive, tied)]
    rows += [("one side", True, 1.0), ("tied", None, 7.0), ("smooth", True, None), ("flat", True, 2.0), ("flat", False, 2.0)]
    return spark.createDataFrame(rows, "model string, positive boolean, s double").repartition(4)


def exact(df):
    found = auroc(df.filter("s IS NOT NULL"), F.col("s"), F.col("positive"), ["model"])
    return {r.model: r.auroc for r in found.collect()}


@pytest.mark.parametrize("width", [1e-2, 1e-4])
def test_interval_holds_the_exact_value(spark, width):
    df = scored(spark, 4000, 1)
    rows = A.scored_rows(df, F.col("s"), F.col("positive"), ["model"]).cache()
    state, _ = A.fit_state(rows, ["model"], width, 32)
    found = {r.model: r for r in A.bounds(state, ["model"]).collect()}
    for model, value in exact(df).items():
        r = found[model]
        if value is None:
            assert r.lower is None and r.upper is None
            continue
        assert r.lower - 1e-12 <= value <= r.upper + 1e-12 and 0 <= r.width <= width
    assert found["flat"].lower == found["flat"].upper == 0.5


def test_days_merge(spark):
    days = [scored(spark, 1500, i) for i in (1, 2, 3)]
    rows = [A.scored_rows(d, F.col("s"), F.col("positive"), ["model"]) for d in days]
    first, edges = A.fit_state(rows[0], ["model"], 1e-3, 64)
    states = [first, *[A.histogram(r, edges, ["model"]) for r in rows[1:]]]
    whole = rows[0].union(rows[1]).union(rows[2])
    together = A.histogram(whole, edges, ["model"])
    order = ["model", "bin"]
    assert A.merged(states, ["model"]).orderBy(order).collect() == together.select("model", "identity", "bin", "pos", "neg", "least", "most").orderBy(order).collect()
    value = exact(days[0].union(days[1]).union(days[2]))
    for r in A.bounds(A.merged(states, ["model"]), ["model"]).collect():
        if r.lower is not None:
            assert r.lower - 1e-12 <= value[r.model] <= r.upper + 1e-12 and r.width < 0.02
    assert A.fit_state(rows[0].limit(0), ["model"])[0].count() == 0


@pytest.mark.parametrize("words", [1 << 20, 2])
def test_unseen_by_filter_counts_the_same(spark, monkeypatch, words):
    monkeypatch.setattr(profile, "FILTER_WORDS", words)
    fit = spark.createDataFrame([(f"a{i % 60}", f"b{i % 5}") for i in range(300)] + [(None, "b1")], "x string, y string")
    other = spark.createDataFrame(
        [(f"a{i % 90}", f"b{i % 7}" if i % 3 else "b1") for i in range(500)] + [("a1", ""), ("", "b2")] + [("new", "b1")] * 300, "x string, y string"
    )
    wanted = sorted(map(tuple, unseen_categories(fit, other, ["x", "y"]).collect()))
    assert sorted(map(tuple, unseen_by_filter(fit, other, ["x", "y"]).collect())) == wanted
    nothing = unseen_by_filter(fit.limit(0), other, ["x", "y"])
    assert sorted(map(tuple, nothing.collect())) == [("x", 802), ("y", 802)]
    assert sorted(map(tuple, unseen_by_filter(fit, other.limit(0), ["x"]).collect())) == [("x", 0)]


def test_null_values_are_unseen_either_way(spark):
    fit = spark.createDataFrame([("a",), (None,)], "x string")
    other = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    wanted = unseen_categories(fit, other, ["x"]).collect()
    assert unseen_by_filter(fit, other, ["x"]).collect() == wanted
