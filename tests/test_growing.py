"""Ledgers and samples that grow, against one run over everything."""

import os

import pytest
from pyspark.sql import functions as F

from flowmark.operators import growing
from flowmark.operators.growing import GrowingCap, GrowingQuota
from flowmark.operators.sampling import class_cap, class_counts, quota_sample, quotas
from flowmark.sources import ledger, scan
from flowmark.sources.ledger import CensusLedger
from flowmark.sources.versions import Versions


def write(spark, path, rows, parts=1):
    spark.createDataFrame(rows, "uid int, label_tactic string").coalesce(parts).write.parquet(path)


def found(df):
    return sorted(map(str, df.collect()))


def test_ledger_opens_files_once(spark, tmp_path, monkeypatch):
    data, own = str(tmp_path / "data"), CensusLedger(spark, str(tmp_path / "ledger"))
    write(spark, f"{data}/a b", [(i, "x" if i % 3 else None) for i in range(30)])
    write(spark, f"{data}/c", [(i, "y") for i in range(5)])
    assert own.update(data) == 2
    monkeypatch.setattr(ledger, "scan", lambda *a: pytest.fail("a data file was opened"))
    assert own.update(data) == 0
    assert found(own.classes(data)) == found(scan.class_census(scan.scan(spark, data), "label_tactic"))
    monkeypatch.undo()
    opened = []
    monkeypatch.setattr(ledger, "scan", lambda s, paths: opened.extend(paths) or scan.scan(s, paths))
    write(spark, f"{data}/d", [(1, "z"), (2, "y")])
    assert own.update(data) == 1 and len(opened) == 1
    assert found(own.schemas(data)) == found(scan.schema_census(spark, data))
    census = scan.totals(spark, "toy", scan.file_census(spark, data), scan.schema_census(spark, data))
    assert found(own.totals(data, "toy")) == found(census)


def test_ledger_takes_back_what_has_gone_or_changed(spark, tmp_path):
    data, own = str(tmp_path / "data"), CensusLedger(spark, str(tmp_path / "ledger"))
    write(spark, f"{data}/a", [(i, "x") for i in range(4)])
    write(spark, f"{data}/b", [(i, "y") for i in range(6)])
    own.update(data)
    (file,) = (tmp_path / "data" / "a").glob("*.parquet")
    file.unlink()
    assert own.update(data) == 0
    assert [tuple(r) for r in own.classes(data).collect()] == [("y", 6)]
    (file,) = (tmp_path / "data" / "b").glob("*.parquet")
    other = str(tmp_path / "other")
    write(spark, other, [(i, "w") for i in range(9)])
    (new,) = (tmp_path / "other").glob("*.parquet")
    os.replace(new, file)
    (crc,) = file.parent.glob(f".{file.name}.crc")
    crc.unlink()
    assert own.update(data) == 1
    assert [tuple(r) for r in own.classes(data).collect()] == [("w", 9)]
    assert own.totals(data, "t").first().rows == 9
    assert own.update(str(tmp_path / "nowhere")) == 0


def test_updates_that_were_not_committed_do_not_count(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.committed() == [] and store.read("t", "a int", []).count() == 0
    store.write("t", spark.range(3).select(F.col("id").cast("int").alias("a")), 1)
    assert store.next() == 1
    store.write("t", spark.range(2).select(F.col("id").cast("int").alias("a")), 1)
    store.commit(1)
    assert store.committed() == [1] and store.read("t", "a int", [1]).count() == 2


def flows(spark, n, seed=0):
    label = F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 3 == 0, None).otherwise("common")
    # one key holds a third of the rows
    key = F.when(F.col("id") % 3 == 1, -1).otherwise(F.col("id")).alias("key")
    return spark.range(seed, seed + n).select(key, label.alias("label"), F.col("id").alias("x"))


def test_capped_sample_of_halves_is_that_of_the_whole(spark, tmp_path):
    halves = [flows(spark, 400), flows(spark, 300, 400), flows(spark, 5, 700)]
    state = GrowingCap(spark, str(tmp_path), ["label"], ["key"], 50)
    for i, half in enumerate(halves):
        got = state.add(half)
        whole = halves[0]
        for other in halves[1 : i + 1]:
            whole = whole.union(other)
        assert found(got) == found(class_cap(whole, ["label"], ["key"], 50))
    assert found(state.counts(whole)) == found(class_counts(whole, ["label"]))
    assert state.add(whole.limit(0)).count() == got.count()


@pytest.mark.parametrize("margin", [0.25, -0.9])
def test_quota_sample_of_halves_is_that_of_the_whole(spark, tmp_path, margin):
    halves = [flows(spark, 500), flows(spark, 700, 500)]
    whole = halves[0].union(halves[1])
    state = GrowingQuota(spark, str(tmp_path), "label", ["key"], 0.8, protected=["rare"], margin=margin)
    for half in halves:
        state.add(half)
    wanted = quotas(class_counts(whole, ["label"]), 0.8, label="label", protected=["rare"])
    expected = found(quota_sample(whole, wanted, ["label"], ["key"]))
    assert found(state.sample(whole, whole)) == expected
    if margin < 0:
        with pytest.raises(ValueError, match="whole table"):
            state.sample(whole)
    assert growing.REACH_BITS == 16
