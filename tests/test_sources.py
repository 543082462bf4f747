import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flowmark.fixed_values import DATASET_2022
from flowmark.operators.tasks import STUDY_DATASETS, DatasetSpec
from flowmark.sources import artifacts as A
from flowmark.sources import scan as S
from flowmark.sources.published import CELL_COLUMNS, errata, published_cells


@pytest.fixture()
def root(spark, tmp_path):
    """Two week folders with three files of one schema, one of them empty, and a blank in a name."""
    base = tmp_path / "flow data"
    rows = [("none", 1.0)] * 5 + [("Discovery", 2.0)] * 2 + [(None, 3.0)]
    df = spark.createDataFrame(rows, "label_tactic string, duration double")
    df.coalesce(1).write.parquet(str(base / "week=1"))
    df.filter("label_tactic = 'none'").coalesce(1).write.parquet(str(base / "week=2"))
    df.limit(0).coalesce(1).write.parquet(str(base / "empty+one"))
    return str(base)


def test_census(spark, root):
    whole = S.scan(spark, root)
    assert whole.columns == ["label_tactic", "duration"] and whole.count() == 13
    files = S.file_census(spark, root).collect()
    assert sorted(r.rows for r in files) == [0, 5, 8] and all(r.bytes > 0 for r in files)
    assert [r.files for r in S.schema_census(spark, root).collect()] == [3]
    classes = [(r.label_tactic, r.n) for r in S.class_census(whole, "label_tactic").collect()]
    assert classes == [("none", 10), ("Discovery", 2), (None, 1)]


def test_class_census_reads_one_column(spark, root):
    plan = S.class_census(S.scan(spark, root), "label_tactic")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<label_tactic:string>" in plan


def actual(spark, spec, files, rows, counts, schemas):
    total = spark.createDataFrame(
        [(spec.name, files, rows, schemas)], "dataset string, files bigint, rows bigint, schemas bigint"
    )
    classes = spark.createDataFrame(
        [(spec.name, c, n) for c, n in counts.items()], "dataset string, label_tactic string, n bigint"
    )
    return total, classes


@pytest.mark.parametrize("spec", STUDY_DATASETS.values(), ids=lambda s: s.name)
def test_validation_accepts_expected_counts(spark, spec):
    found = actual(spark, spec, spec.files, spec.rows, spec.class_rows, 1)
    assert S.validate(*found, S.expected_totals(spark, [spec]), S.expected_classes(spark, [spec])).isEmpty()


def test_validation_reports_four_problems(spark):
    spec = STUDY_DATASETS[DATASET_2022]
    found = actual(spark, spec, 7, 1, {}, 0)
    problems = S.validate(*found, S.expected_totals(spark, [spec]), S.expected_classes(spark, [spec]))
    messages = {r.problem: r.message for r in problems.collect()}
    assert messages == {
        "files": "files: expected 8, found 7",
        "rows": "rows: expected 18562468, found 1",
        "classes": "label_tactic counts do not match the paper dataset",
        "schemas": "expected one schema, found 0",
    }
    with pytest.raises(RuntimeError, match="expected 8, found 7"):
        S.require_valid(problems)


def test_inventory_of_folders(spark, root):
    good = DatasetSpec("good", ("Discovery",), files=3, rows=13, class_rows={"none": 10, "Discovery": 2, None: 1})
    bad = DatasetSpec("bad", ("Discovery",), files=3, rows=13, class_rows={"none": 10, "Discovery": 3})
    out = S.inventory(spark, {"good": root, "bad": root}, [good, bad])
    assert [(r.dataset, r.problem) for r in out["problems"].collect()] == [("bad", "classes")]
    S.require_valid(out["problems"].filter("dataset = 'good'"))
    assert out["files"].count() == 6 and out["classes"].count() == 6
    assert {r.dataset: (r.files, r.rows, r.schemas) for r in out["totals"].collect()} == {
        "good": (3, 13, 1), "bad": (3, 13, 1),
    }


def test_inventory_of_a_missing_folder(spark, tmp_path):
    spec = DatasetSpec("gone", (), files=1, rows=5, class_rows={"none": 5})
    for root in (str(tmp_path / "nowhere"), str(tmp_path)):
        problems = S.inventory(spark, {"gone": root}, [spec])["problems"].collect()
        assert {r.problem for r in problems} == {"files", "rows", "classes", "schemas"}


def test_csv_and_json_tables(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"", None, 1.5), ("", 2, None)], "t string, k int, v double")
    path = str(tmp_path / "plain")
    A.write_table(df, path)
    back = A.read_table(spark, path, df.schema)
    assert {(r.t, r.k, r.v) for r in back.collect()} >= {('a,"b"', None, 1.5)}
    assert back.count() == 2
    nested = df.select("k", F.array("v").alias("history"), F.create_map("t", "v").alias("m"))
    A.write_table(nested, str(tmp_path / "nested"), "json", by=["k"])
    assert A.read_table(spark, str(tmp_path / "nested"), nested.schema, "json").count() == 2
    A.write_table(nested, str(tmp_path / "text"))
    assert spark.read.csv(str(tmp_path / "text"), header=True).columns == nested.columns
    empty = A.read_table(spark, str(tmp_path / "nowhere"), df.schema)
    assert empty.count() == 0 and empty.schema == df.schema
    (tmp_path / "blank.csv").write_text("")
    assert A.read_table(spark, str(tmp_path / "blank.csv"), df.schema).count() == 0


def test_a_run_counts_only_with_its_manifest(spark, tmp_path):
    table = spark.createDataFrame([(1,)], "x int")
    base = f"{tmp_path}/run-1"
    A.write_table(table, f"{base}/t")
    assert not A.is_complete(spark, base)
    with pytest.raises(FileNotFoundError):
        A.read_manifest(spark, base)
    base = A.publish_run(spark, {"t": table}, str(tmp_path), "run-2", {"config": {"method": "m"}})
    assert A.is_complete(spark, base)
    assert A.read_manifest(spark, base)["config"] == {"method": "m"}
    assert A.read_table(spark, f"{base}/t", "x int").collect() == table.collect()


def test_published_cells(spark):
    cells = published_cells(spark)
    assert cells.columns == CELL_COLUMNS
    rows = cells.collect()
    assert len(rows) == 905
    assert {r.table for r in rows} == set(range(5, 23))
    assert {r.reference_version for r in rows} == {1}
    excluded = [r for r in rows if r.status == "excluded"]
    assert len(excluded) == 25 and all(r.note for r in excluded)
    assert {(r.table, r.metric) for r in excluded if r.table != 10} == {(6, "weighted_f1")}
    value = {(r.table, r.task, r.k, r.metric): r for r in rows}
    assert value[5, "Reconnaissance", None, "attack_fpr"].paper_value == 0.14 / 100
    assert value[6, "Multinomial", 3, "weighted_f1"].paper_value == 97.734 / 100
    assert value[7, "Discovery", 2, "cumulative_variance"].paper_value == (20.82 + 15.11) / 100
    assert value[20, "Multinomial", 2, "cpu_training_seconds"].paper_value == 1630.58
    assert value[22, "Discovery", 1, "gpu_mr_testing_seconds"].unit == "seconds"
    assert value[18, "Discovery", 1, "cpu_mr_training_seconds"].preprocessing == "lda-mapreduce"
    assert {(r.table, r.page) for r in rows} >= {(5, 14), (22, 23)}
    assert errata(spark).count() == 6


@pytest.mark.parametrize("name", ["ts=00%3A10", "100%", "a+b c", "ü x=%20"])
def test_census_of_escaped_names(spark, tmp_path, name):
    folder = tmp_path / name
    folder.mkdir()
    pq.write_table(pa.table({"x": [1, 2, 3]}), folder / f"{name}.parquet")
    (row,) = S.file_census(spark, str(tmp_path).replace("%", "%25")).collect()
    assert row.rows == 3
