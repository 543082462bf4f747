"""Cutting lineage on shared storage, null-safe joins and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits under which a side table may be kept on the driver and broadcast.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 32 << 20
#: Size of a partition of training data.
PARTITION_BYTES = 64 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local session that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="flowmark-checkpoint-")
    context.setCheckpointDir(named)


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder, so that a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_table(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> pa.Table | None:
    """The rows of a narrow side table if they are few and small enough, else ``None``."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows and table.nbytes <= BROADCAST_BYTES else None


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows the driver knows, as a relation whose size the optimizer knows too."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    table = pa.Table.from_arrays([pa.array(list(c)) for c in columns], names=fields.names)
    return spark.createDataFrame(table, fields)


def side_table(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a side table once. It is broadcast only if its rows and bytes allow that; a larger
    one is kept in the checkpoint folder and joined by a shuffle."""
    table = bounded_table(df, max_rows)
    if table is None:
        return durable(df)
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def compact(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Merge partitions of a table of known size down to ``PARTITION_BYTES`` each.

    Iterative fits run several jobs per step, so a small table should be in few partitions. A
    large one keeps the partitions it has.
    """
    return df.coalesce(max(1, -(-rows * row_bytes // PARTITION_BYTES)))


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which null keys match each other; key columns come from the left."""
    if not on:
        raise ValueError("join needs at least one column")
    renamed = right.select(
        *[F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in right.columns]
    )
    condition = None
    for name in on:
        term = left[name].eqNullSafe(renamed[f"__on_{name}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"__on_{c}" for c in on])
