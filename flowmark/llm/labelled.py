"""Labels of documents and the held-out part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of an id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def labels_of(labels: DataFrame, label_col: str, held_out, id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``good`` (label 1) of the rows to learn from: not held out, with id and label.

    ``held_out`` makes a condition of an id column. An id with several labels has the greatest.
    """
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    return (
        named.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("label") == 1).alias("good"))
    )


def sample_per_label(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows with ``good`` and ``n`` without, those of the least hashes of their ids."""
    some = [
        rows.filter(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for which in (F.col("good"), ~F.col("good"))
    ]
    return some[0].unionByName(some[1])
