"""Parquet scans, inventories and their validation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmark.fixed_values import CLASS_MISMATCH_TEXT
from flowmark.functions.durable import local_table, null_safe_join
from flowmark.operators.tasks import DatasetSpec

PROBLEM_SCHEMA = "dataset string, problem string, message string"


def scan(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All Parquet files under ``path``; folder names are not read as partitions."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("recursiveFileLookup", "true").parquet(*paths)


def listing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Path and size of every Parquet file; file contents are not read.

    A folder that does not exist holds no files.
    """
    return stamped_listing(spark, path).drop("modified")


def stamped_listing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """:func:`listing` with the time at which each file was ``modified``."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
    )
    try:
        return reader.load(paths).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], "path string, bytes bigint, modified timestamp")


def file_census(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Bytes and rows per file, empty files included. Rows come from the footers."""
    files = listing(spark, path)
    if files.isEmpty():
        return files.withColumn("rows", F.lit(0).cast("bigint"))
    rows = (
        scan(spark, path)
        .groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return (
        files
        .withColumn("__tail", _path_key(F.col("path")))
        .join(rows.select(_path_key(_decoded("path")).alias("__tail"), "rows"), "__tail", "left")
        .select("path", "bytes", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"))
    )


def _path_key(path: Column) -> Column:
    # the two readers spell a local path as file:/x or file:///x
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def _decoded(column: str) -> Column:
    # the metadata column escapes a path as an URI, the listing does not
    return F.url_decode(F.regexp_replace(F.col(column), r"\+", "%2B"))


def schemas_of(files: DataFrame) -> DataFrame:
    """``path`` and ``schema`` of Parquet files; one footer per file is read, on the executors."""

    def footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for frame in frames:
            schemas = []
            for name in frame["path"]:
                if name.startswith("file:"):
                    name = "/" + name.removeprefix("file:").lstrip("/")
                # the object store's name in Hadoop and in Arrow
                name = re.sub(r"^s3[an]://", "s3://", name)
                store, inside = fs.FileSystem.from_uri(name)
                schemas.append(str(pq.read_schema(inside, filesystem=store)))
            yield frame[["path"]].assign(schema=schemas)

    return files.select("path").mapInPandas(footers, "path string, schema string")


def schema_census(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Number of files per distinct schema."""
    return schemas_of(listing(spark, path)).groupBy("schema").agg(F.count(F.lit(1)).alias("files"))


def class_census(df: DataFrame, label_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class, null included, most common first. Only the label column is scanned."""
    return (
        df.groupBy(*by, F.col(label_col).alias("label_tactic"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(*by, F.desc("n"), "label_tactic")
    )


def totals(
    spark: SparkSession, dataset: str, files: DataFrame, schemas: DataFrame
) -> DataFrame:
    """Files, rows, bytes and number of schemas of a dataset, in one row."""
    sizes = files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )
    kinds = schemas.agg(F.count(F.lit(1)).alias("schemas"))
    key = F.lit(dataset).alias("dataset")
    return sizes.select(key, "*").join(kinds.select(key, "*"), "dataset")


def expected_totals(spark: SparkSession, specs: Iterable[DatasetSpec]) -> DataFrame:
    rows = [(s.name, s.files, s.rows) for s in specs]
    return local_table(spark, rows, "dataset string, expected_files bigint, expected_rows bigint")


def expected_classes(spark: SparkSession, specs: Iterable[DatasetSpec]) -> DataFrame:
    rows = [(s.name, c, n) for s in specs for c, n in s.class_rows.items()]
    return local_table(spark, rows, "dataset string, label_tactic string, expected bigint")


def validate(
    actual: DataFrame, classes: DataFrame, expected: DataFrame, expected_class_rows: DataFrame
) -> DataFrame:
    """One row per problem: wrong files, rows, class counts, or more than one schema.

    ``actual`` has a row of :func:`totals` per dataset and ``classes`` its class counts
    ``(dataset, label_tactic, n)``; the other two say what is expected.
    """
    both = expected.join(actual, "dataset", "left").na.fill(0, ["files", "rows", "schemas"])
    pair = ["dataset", "label_tactic"]
    differing = (
        classes.select(*pair, "n", F.lit(None).cast("bigint").alias("expected"))
        .unionByName(
            expected_class_rows.select(*pair, F.lit(None).cast("bigint").alias("n"), "expected")
        )
        .groupBy(*pair)
        .agg(F.sum("n").alias("n"), F.sum("expected").alias("expected"))
        .filter(~F.col("n").eqNullSafe(F.col("expected")))
        .select("dataset")
        .distinct()
        .withColumn("__differs", F.lit(True))
    )
    both = null_safe_join(both, differing, ["dataset"], "left")

    def wrong(name: str):
        text = F.format_string(
            f"{name}: expected %d, found %d", F.col(f"expected_{name}"), F.col(name)
        )
        return F.when(
            F.col(name) != F.col(f"expected_{name}"),
            F.struct(F.lit(name).alias("problem"), text.alias("message")),
        )

    found = F.array(
        wrong("files"),
        wrong("rows"),
        F.when(
            F.col("__differs"),
            F.struct(F.lit("classes").alias("problem"), F.lit(CLASS_MISMATCH_TEXT).alias("message")),
        ),
        F.when(
            F.col("schemas") != 1,
            F.struct(
                F.lit("schemas").alias("problem"),
                F.format_string("expected one schema, found %d", F.col("schemas")).alias("message"),
            ),
        ),
    )
    return both.select("dataset", F.explode(F.array_compact(found)).alias("__p")).select(
        "dataset", "__p.problem", "__p.message"
    )


def inventory(
    spark: SparkSession,
    roots: dict[str, str],
    specs: Sequence[DatasetSpec],
    label_col: str | dict[str, str] = "label_tactic",
) -> dict[str, DataFrame]:
    """Files, schemas, classes and problems of several datasets, ``dataset`` as a column.

    ``label_col`` is the label column of all datasets, or of each by its name.
    """
    files, schemas, classes, sums = [], [], [], []
    for spec in specs:
        key = F.lit(spec.name).alias("dataset")
        label = label_col if isinstance(label_col, str) else label_col[spec.name]
        own_files = file_census(spark, roots[spec.name])
        own_schemas = schema_census(spark, roots[spec.name])
        files.append(own_files.select(key, "*"))
        schemas.append(own_schemas.select(key, "*"))
        rows = (
            local_table(spark, [], f"{label} string")
            if own_files.isEmpty()
            else scan(spark, roots[spec.name])
        )
        counted = rows.groupBy(F.col(label).alias("label_tactic"))
        classes.append(counted.agg(F.count(F.lit(1)).alias("n")).select(key, "*"))
        sums.append(totals(spark, spec.name, own_files, own_schemas))

    def stack(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    counted = stack(classes)
    return {
        "files": stack(files),
        "schemas": stack(schemas),
        "classes": counted.orderBy("dataset", F.desc("n"), "label_tactic"),
        "totals": stack(sums),
        "problems": validate(
            stack(sums), counted, expected_totals(spark, specs), expected_classes(spark, specs)
        ),
    }


def require_valid(problems: DataFrame) -> None:
    """Refuse to go on if an inventory reports anything."""
    found = problems.limit(20).collect()
    if found:
        text = "; ".join(f"{r['dataset']}: {r['message']}" for r in found)
        raise RuntimeError(f"full run refused because inventory validation failed: {text}")
