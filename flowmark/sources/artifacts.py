"""Result tables on disk: writers, readers and the rule that a run counts only when complete."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest"
#: Tables that hold nested values are written as JSON, the others as CSV.
CSV_OPTIONS = {"header": "true", "escape": '"'}


def write_table(df: DataFrame, path: str, fmt: str = "csv", by: Sequence[str] = ()) -> None:
    """Write a table through Spark's committer; an existing table is an error."""
    if fmt == "csv":
        # maps and arrays have no CSV form, so they go out as JSON text
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(
            *[
                F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                for f in df.schema.fields
            ]
        )
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv"
) -> DataFrame:
    """Read a table with its schema; a missing or empty one is an empty table."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS).option("enforceSchema", "false")
    try:
        return reader.load(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def publish_run(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    root: str,
    run_id: str,
    manifest: dict | None = None,
) -> str:
    """Write all tables of a run and, last of all, its manifest.

    A rename of the finished folder is not atomic on object stores. Readers take a run only if
    its manifest is committed, see :func:`is_complete`.
    """
    base = f"{root.rstrip('/')}/{run_id}"
    for name, table in tables.items():
        nested = any(
            isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            for f in table.schema.fields
        )
        write_table(table, f"{base}/{name}", "json" if nested else "csv")
    document = json.dumps({"run_id": run_id, "tables": sorted(tables), **(manifest or {})})
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(
        f"{base}/{MANIFEST}"
    )
    return base


def is_complete(spark: SparkSession, base: str) -> bool:
    """True if the manifest of a run was committed."""
    try:
        return not spark.read.text(f"{base}/{MANIFEST}").isEmpty()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def read_manifest(spark: SparkSession, base: str) -> dict:
    """Manifest of a complete run."""
    if not is_complete(spark, base):
        raise FileNotFoundError(f"{base} holds no complete run")
    return json.loads(spark.read.text(f"{base}/{MANIFEST}").first()[0])
