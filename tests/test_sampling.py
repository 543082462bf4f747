import random

import pytest
from pyspark.sql import functions as F

from flowmark.fixed_values import DATASET_2022
from flowmark.operators.sampling import (
    class_cap,
    hash_split,
    quota_sample,
    quotas,
    random_split,
    sample_for_run,
    sample_metadata,
    split_for_run,
)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def flows(spark, spec):
    rows = [(f"{c}{i}", c, float(i)) for c, n in spec.items() for i in range(n)]
    return spark.createDataFrame(rows, "uid string, label_tactic string, duration double")


def test_cap_is_exact_and_split_repeats(spark):
    df = flows(spark, {"none": 10, "Discovery": 10})
    capped = class_cap(df, ["label_tactic"], ["uid"], 4)
    counts = {r.label_tactic: r["count"] for r in capped.groupBy("label_tactic").count().collect()}
    assert counts == {"none": 4, "Discovery": 4}
    first = rows_of(hash_split(df, ["uid"], 42))
    assert first == rows_of(hash_split(df.repartition(5), ["uid"], 42))


def test_seed_is_an_int_literal(spark):
    df = flows(spark, {"none": 50})
    split = hash_split(df, ["uid"], 42).select("uid", "split")
    by_hand = df.select(
        "uid",
        F.when(F.expr("pmod(xxhash64(uid, 42), 10000) < 7000"), "train").otherwise("test"),
    )
    assert rows_of(split) == rows_of(by_hand)


@pytest.fixture(params=[500_000, 20, 0], ids=lambda n: f"edge{n}")
def edge_rows(request, monkeypatch):
    """Rows that may be ranked in one task: with fewer, deeper levels are taken."""
    monkeypatch.setattr("flowmark.operators.sampling.EDGE_ROWS", request.param)
    monkeypatch.setattr("flowmark.operators.sampling.PREFIX_BITS", (3, 6, 20))
    return request.param


@pytest.mark.parametrize("kind,cap", [("xxhash64", 7), ("xxhash64", 350), ("md5", 100), ("md5", 5000)])
def test_cutoff_equals_window(spark, edge_rows, kind, cap):
    """Unique keys, keys with many payloads, whole copies, null classes and a single-row class."""
    rnd = random.Random(cap)
    rows = [(f"k{i}", rnd.choice("ab"), i) for i in range(800)]
    rows += [("hot", "a", i % 40) for i in range(300)]  # one key, copies of 40 payloads
    rows += [("same", "c", 1)] * 400  # copies only
    rows += [("solo", "d", 0)]
    rows += [(f"n{i}", None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "uid string, label_tactic string, x int").repartition(4)
    args = (["label_tactic"], ["uid"], cap)
    window = class_cap(df, *args, kind=kind, strategy="window")
    cutoff = class_cap(df, *args, kind=kind, strategy="cutoff")
    assert rows_of(cutoff) == rows_of(window)
    assert cutoff.columns == df.columns


def test_cutoff_edge_inside_one_hot_key(spark, edge_rows):
    """Every place of the class is decided among rows of one key."""
    rows = [("hot", "a", i) for i in range(5000)]
    df = spark.createDataFrame(rows, "uid string, label_tactic string, x int")
    args = (["label_tactic"], ["uid"], 1234)
    cutoff = class_cap(df, *args, strategy="cutoff")
    assert cutoff.count() == 1234
    assert rows_of(cutoff) == rows_of(class_cap(df, *args, strategy="window"))


def test_hot_copies_are_cut_and_written_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("flowmark.operators.sampling.EDGE_ROWS", 100)
    df = spark.range(60_000).select(
        F.lit("hot").alias("uid"), F.lit("a").alias("label_tactic"), F.lit(1.5).alias("x")
    )
    cutoff = class_cap(df, ["label_tactic"], ["uid"], 45_678, strategy="cutoff")
    assert cutoff.count() == 45_678


def test_empty_input_keeps_schema(spark):
    df = flows(spark, {"none": 1}).limit(0)
    for strategy in ("window", "cutoff"):
        out = class_cap(df, ["label_tactic"], ["uid"], 3, strategy=strategy)
        assert out.schema.names == df.schema.names and out.count() == 0


def test_null_key_falls_back(spark):
    rows = [(None, "a", 1), (None, "a", 2), ("u", "a", 3)]
    df = spark.createDataFrame(rows, "uid string, label_tactic string, x int")
    split = hash_split(df, ["uid"], fallback_cols=df.columns)
    by_hand = df.withColumn(
        "split",
        F.when(
            F.expr("pmod(xxhash64(coalesce(uid, concat_ws('|', uid, label_tactic, x)), 42), 10000) < 7000"),
            "train",
        ).otherwise("test"),
    )
    assert rows_of(split) == rows_of(by_hand)


def allot(counts, reduction, protected):
    """Brute force of the quota rule, one place at a time."""
    total = sum(counts.values())
    target = max(1, round(total * (1 - reduction)))
    out = {c: n for c, n in counts.items() if c in protected}
    free = {c: n for c, n in counts.items() if c not in protected}
    places = max(0, target - sum(out.values()))
    size = max(sum(free.values()), 1)
    for c, n in free.items():
        out[c] = min(n, places * n // size)
    spare = places - sum(out[c] for c in free)
    for c in sorted(free, key=lambda c: (-free[c], c)):
        while spare > 0 and out[c] < free[c]:
            out[c] += 1
            spare -= 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_quota_rule(spark, seed):
    rnd = random.Random(seed)
    names = ["none", "Discovery", "a", "b", "c"][: rnd.randint(1, 5)]
    counts = {c: rnd.randint(1, 4000) for c in names}
    reduction = rnd.choice([0.975, 0.5, 0.1, 0.999, 0.03])
    table = spark.createDataFrame(list(counts.items()), "label_tactic string, n bigint")
    got = {r.label_tactic: r.quota for r in quotas(table, reduction).collect()}
    assert got == allot(counts, reduction, {"Discovery"})


def test_quota_rounds_half_to_even_and_protects(spark):
    table = spark.createDataFrame([("a", 49)], "label_tactic string, n bigint")
    assert quotas(table, 0.5).first().quota == 24
    over = spark.createDataFrame([("Discovery", 90), ("a", 10)], "label_tactic string, n bigint")
    got = {r.label_tactic: r.quota for r in quotas(over, 0.9).collect()}
    assert got == {"Discovery": 90, "a": 0}
    unchanged = {r.label_tactic: r.quota for r in quotas(over, 0.0).collect()}
    assert unchanged == {"Discovery": 90, "a": 10}


def test_quotas_of_very_large_classes(spark):
    table = spark.createDataFrame(
        [("a", 6 * 10**12), ("b", 3 * 10**12)], "label_tactic string, n bigint"
    )
    got = {r.label_tactic: r.quota for r in quotas(table, 0.9).collect()}
    assert got == {"a": 6 * 10**11, "b": 3 * 10**11}


def test_published_sample_size_is_exact(spark):
    df = flows(spark, {"none": 600, "Reconnaissance": 400, "Discovery": 20})
    sampled, policy = sample_for_run(
        df,
        dataset=DATASET_2022,
        stage="pca",
        task="Multinomial",
        profile="full",
        method="paper-compatible",
        cap=10,
        key_cols=["uid"],
    )
    assert policy["reported_reduction"] == 0.95
    assert (policy["source_rows"], policy["target_rows"]) == (1020, 51)
    assert policy["target_class_counts"]["Discovery"] == 20 and policy["protected_retained"]
    assert sampled.count() == round(1020 * 0.05)
    assert sampled.filter("label_tactic = 'Discovery'").count() == 20


def test_quota_sample_equals_ranked_rows(spark):
    df = flows(spark, {"none": 300, "b": 200, "Discovery": 9})
    table = quotas(df.groupBy("label_tactic").agg(F.count("*").alias("n")), 0.8)
    got = quota_sample(df, table, ["label_tactic"], ["uid"])
    wanted = {r.label_tactic: r.quota for r in table.collect()}
    for name, quota in wanted.items():
        own = df.filter(F.col("label_tactic") == name)
        ranked = own.orderBy(F.expr("xxhash64(uid, 42)"), "uid").limit(quota)
        assert rows_of(got.filter(F.col("label_tactic") == name)) == rows_of(ranked)
    info = sample_metadata(table, 0.8).first()
    assert info.target_rows == sum(wanted.values()) and info.protected_retained


def test_dispatch(spark):
    df = flows(spark, {"none": 40, "Discovery": 5})
    common = dict(stage="minimal", task="Discovery", cap=3, key_cols=["uid"])
    capped, policy = sample_for_run(
        df, dataset="d", profile="development", method="corrected", **common
    )
    assert capped.count() == 6 and policy["cap_per_class"] == 3
    whole, policy = sample_for_run(df, dataset="d", profile="full", method="corrected", **common)
    assert whole is df and policy == {"policy": "full-eligible-data"}
    split = split_for_run(df, dataset="d", task="t", method="corrected", key_cols=["uid"])
    assert rows_of(split) == rows_of(hash_split(df, ["uid"], 42))
    drawn = split_for_run(df, dataset="d", task="t", method="paper-compatible", key_cols=["uid"])
    train, test = (drawn.filter(drawn.split == s).drop("split") for s in ("train", "test"))
    assert rows_of(train) == rows_of(random_split(df, 42)[0])
    assert rows_of(train.union(test)) == rows_of(df)
