"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition makes a run: its digests with the best row of each. Runs are merged in
rounds of a k-nomial tree: in each round the runs whose numbers share all but the lowest bits
become one, and of equal digests the best row stays and the counts add up. A merged run is
spread over tasks by digest, so the last round is no single task, and a digest that a third of the
rows share is one row per run from the first round on. Only digests are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.llm.common import PART_BITS, settled, texts

#: Runs merged into one in a round are two to this power.
FAN_IN_BITS = 4
KEY = ["digest", "n_bytes", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``row`` and what tells its text from others. Checkpointed.

    SHA-256 alone decides; the length and a second, independent hash verify it at every merge.
    """
    return durable(
        texts(docs, id_col, text_col).select(
            "doc_id",
            "row",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.octet_length("text").alias("n_bytes"),
            F.xxhash64("text").alias("check"),
        )
    )


def merge_runs(rows: DataFrame, keep: str, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """``digest``, ``best`` (doc_id and row that stay) and ``group_size`` of each distinct text."""
    best = F.max if keep == "largest" else F.min
    # nulls last for the smallest, first for the largest: a row with an id is preferred
    place = F.struct(
        (F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()).alias("o"),
        "doc_id",
        "row",
    )
    runs = (
        rows.withColumn("run", F.shiftright("row", PART_BITS).cast("int"))
        .withColumn("best", place)
        .withColumn("group_size", F.lit(1).cast("long"))
    )
    last = rows.agg(F.max(F.shiftright("row", PART_BITS))).first()[0] or 0
    while True:
        # The aggregation sorts by key inside each task and merges the sorted runs it is sent.
        runs = (
            runs.withColumn("run", F.shiftright("run", fan_in_bits))
            .groupBy("run", *KEY)
            .agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
        last >>= fan_in_bits
        if not last:
            return runs.drop("run")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row``, ``keep_id``, ``keep_row``, ``group_size``,
    ``kept`` and ``text_sha256``.

    Texts are equal when identical; a null text counts as empty, and an empty text is a text like
    others. Of equal texts the row with the ``largest`` (or ``smallest``) id stays; a null id
    only stays where all are null, and of rows with the same id one stays. No rows, no result rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")
    rows = digests(docs, id_col, text_col)
    groups = merge_runs(rows, keep)
    return rows.join(groups, KEY).select(
        "doc_id",
        "row",
        F.col("best.doc_id").alias("keep_id"),
        F.col("best.row").alias("keep_row"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest"
) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns."""
    docs = settled(docs)
    kept = exact_duplicates(docs, id_col, text_col, keep).filter("kept").select(
        F.col("row").alias("__row")
    )
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return numbered.join(kept, "__row", "left_semi").drop("__row")
