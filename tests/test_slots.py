"""Slots and collisions of the feature hasher, and splits with exact shares."""

import pytest
from pyspark.ml.feature import FeatureHasher
from pyspark.sql import functions as F

from flowmark.operators import sampling
from flowmark.operators.profile import hash_collisions, hashed_slot
from flowmark.operators.sampling import content_split, hash_split, stratified_split

TEXTS = ["", "a", "ab", "abc", "abcd", "abcde", "é", "日本語", "𝔘x", "10.0.0.1", "x" * 101, " ", "a=b", "\x00", "0", "ÿÿÿÿÿ"]


@pytest.mark.parametrize("buckets", [256, 1000, 7])
def test_slots_are_those_of_the_hasher(spark, buckets):
    rows = spark.createDataFrame([(t + s,) for t in TEXTS for s in ("", "1", "23")], "c string")
    hasher = FeatureHasher(inputCols=["c"], outputCol="f", numFeatures=buckets, categoricalCols=["c"])
    own = hashed_slot(F.concat(F.lit("c="), "c"), buckets)
    for r in hasher.transform(rows.withColumn("slot", own)).collect():
        assert r.f.indices.tolist() == [r.slot], r.c


def test_collisions(spark):
    rows = [(f"v{i % 40}", f"w{i % 7}" if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    found = hash_collisions(df, ["a", "b"], 16, "p_").collect()
    values = {("a", v): 0 for v, _ in rows} | {("b", w): 0 for _, w in rows if w}
    for v, w in rows:
        values["a", v] += 1
        if w:
            values["b", w] += 1
    named = spark.createDataFrame([(c, v, f"p_{c}={v}") for c, v in values], "c string, v string, t string")
    slots = {(r.c, r.v): r.slot for r in named.select("c", "v", hashed_slot(F.col("t"), 16).alias("slot")).collect()}
    wanted = []
    for key, slot in slots.items():
        same = [k for k, s in slots.items() if s == slot]
        if len(same) > 1:
            wanted.append((slot, *key, values[key], len(same), sum(values[k] for k in same)))
    assert sorted(tuple(r) for r in found) == sorted(wanted)
    assert hash_collisions(df.limit(0), ["a", "b"]).count() == 0


def sides(df, by):
    return {(r[0], r[1]): r[2] for r in df.groupBy(by, "split").count().collect()}


@pytest.mark.parametrize("edge_rows", [500_000, 3])
def test_exact_shares(spark, monkeypatch, edge_rows):
    monkeypatch.setattr(sampling, "EDGE_ROWS", edge_rows)
    # a third of all rows are one row, and a class is null
    rows = [("a", i, 0) for i in range(101)] + [("b", 1, 1)] * 90 + [(None, i % 4, 2) for i in range(33)] + [("c", 5, 5)]
    df = spark.createDataFrame(rows, "label string, key int, x int").repartition(5)
    split = hash_split(df, ["key"], per_class=["label"])
    assert sides(split, "label") == {
        ("a", "train"): 70, ("a", "test"): 31, ("b", "train"): 63, ("b", "test"): 27,
        (None, "train"): 23, (None, "test"): 10, ("c", "test"): 1,
    }
    assert sorted(map(str, split.drop("split").collect())) == sorted(map(str, df.collect()))
    whole = stratified_split(df, ["label"], ["key"], train_fraction=1.0)
    assert whole.filter("split = 'test'").isEmpty() and whole.count() == len(rows)
    assert stratified_split(df, ["label"], ["key"], train_fraction=0.0).filter("split = 'train'").isEmpty()
    # the side of a row depends on its key, not on the partitions
    again = stratified_split(df.repartition(2), ["label"], ["key"])
    assert sorted(map(str, again.collect())) == sorted(map(str, split.collect()))
    assert stratified_split(df.limit(0), ["label"], ["key"]).count() == 0


def test_content_split_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPY_CHUNK", 16)
    rows = [(1, "hot", None)] * 400 + [(i % 50, f"t{i % 9}", float(i % 3)) for i in range(800)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    found = [sorted(map(str, content_split(df.repartition(n)).collect())) for n in (1, 7, 200)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    hot = content_split(df).filter("b = 'hot' AND split = 'train'").count()
    assert 240 < hot < 320
    assert sorted(map(str, content_split(df).drop("split").collect())) == sorted(map(str, df.collect()))
    assert content_split(df, seed=1).exceptAll(content_split(df, seed=2)).count() > 0
    with pytest.raises(ValueError, match="compared"):
        content_split(df.withColumn("m", F.create_map(F.lit(1), F.lit(2))))


def test_literal_hashes(spark):
    """Hashes that samples and splits rest on, as the engine's own functions of a fixed key and seed give them."""
    from flowmark.functions.keys import seeded_hash

    row = spark.range(1).select(
        seeded_hash(F.lit("u1"), 42, "xxhash64").alias("x"),
        seeded_hash(F.lit(None).cast("string"), 42, "xxhash64").alias("n"),
        seeded_hash(F.lit("u1"), 42, "md5").alias("m"),
        F.expr("xxhash64('u1', 42)").alias("own"),
    ).first()
    import hashlib

    assert row.m == int(hashlib.md5(b"u1|42").hexdigest()[:15], 16)
    assert row.x == row.own == XX_U1 and row.n == XX_NULL


# xxhash64 of ('u1', 42) and of (null, 42).
XX_U1, XX_NULL = -7446812027144818283, -387659249110444264
