"""What several operators share: reading, row numbers, running totals over sorted tables."""

from __future__ import annotations

import gc
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmark.functions.durable import durable, ensure_checkpoint_dir, local_table

PART_BITS = 33


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are kept and that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def gathered(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df``, read from a checkpoint and of at most ``rows`` rows, in fewer partitions: two for each core,
    or more if a partition had more than ``most`` rows otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(2 * cores, -(-rows // most)))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table into the checkpoint folder, and read from there."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(docs: DataFrame) -> DataFrame:
    """``docs`` with rows that come in the same order however often, and with whichever columns, they are
    computed, as row numbers need it. Files and checkpoints are like that; what comes out of a shuffle
    is stored first."""
    plan = docs.sparkSession._jvm.PythonSQLUtils.explainString(
        docs._jdf.queryExecution(), "simple"
    )
    return stored(docs) if "Exchange" in plan else docs


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``row``, a number that tells repeated rows apart.

    Other columns are left behind, so their names cannot clash.
    """
    return settled(docs).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )


def running_total(df: DataFrame, within: str, order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` over the rows of the same ``within`` that come
    before a row in ``order`` (which has to be total).

    The table is range partitioned once. Each range adds up its own rows; only one total per range
    and value of ``within`` is summed over the table.
    """
    placed = durable(
        df.repartitionByRange(within, *order)
        .sortWithinPartitions(within, *order)
        .withColumn("__id", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__id", PART_BITS))
    before = (
        Window.partitionBy(within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        placed.groupBy(within, "__part")
        .agg(F.sum(weight).alias("__sum"))
        .select(within, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    )
    inside = (
        Window.partitionBy(within, "__part")
        .orderBy("__id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed.withColumn("__own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [within, "__part"])
        .withColumn(name, F.col("__off") + F.col("__own"))
        .drop("__id", "__part", "__own", "__off")
    )


def known_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver knows, to be broadcast."""
    return F.broadcast(local_table(spark, rows, schema))
