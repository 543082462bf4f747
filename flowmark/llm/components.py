"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import gathered, release

#: Links that a task connects at once.
LINKS = 200_000


def _star(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Every id of the links, with the smallest one that they connect it to."""
    table = pa.Table.from_batches(batches)
    ends = [table.column(c).to_numpy() for c in ("a", "b")]
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(table)], at[len(table) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["v", "root"])


def _stars(most: int):
    """Function that makes stars of the links of a task, ``most`` or a batch more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= most:
                yield _star(waiting)
                waiting = []
        if waiting:
            yield _star(waiting)

    return run


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v`` and ``root``, the smallest id of its component, for every id in ``links`` (``a``, ``b``).

    In every round each task first makes stars of the links it reads: every id with the smallest one
    it reaches, once. They are the result when every id has one centre. Else a large-star and a small-star
    step link an id to the smallest centre next to its own centres, and those centres too. The
    number of links never grows. An id has one row for each ``LINKS`` links at most, other than as a
    centre: members look for what is above their centre, in a join whose skew Spark splits. A round is
    cut off from the one before by a checkpoint.
    """
    ship(links.sparkSession)
    edges = durable(
        links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter(
            "a <> b"
        )
    )
    rows = edges.count()
    for _ in range(max_rounds):
        stars = durable(gathered(edges, rows, LINKS).mapInArrow(_stars(LINKS), "v long, root long"))
        near = durable(
            stars.groupBy("v").agg(
                F.min("root").alias("root"),
                F.max("root").alias("last"),
                F.count(F.lit(1)).alias("n"),
            )
        )
        # a centre has a row of its own; so with one centre for every id, centres have none but themselves
        rows, unsettled = near.agg(F.sum("n"), F.max(F.col("root") != F.col("last"))).first()
        if not unsettled:
            return near.select("v", "root")
        # read in other partitions, so that both sides are dealt out for the join and Spark can split it
        above = (
            gathered(near, rows, LINKS)
            .filter("v = last and root < v")
            .select(F.col("v").alias("root"), F.col("root").alias("least"))
        )
        merged = durable(
            stars.join(above, "root", "left")
            .withColumn("least", F.coalesce("least", "root"))
            .groupBy("v")
            .agg(F.min("least").alias("root"), F.collect_set("least").alias("centres"))
        )
        ends = F.explode(F.array_union("centres", F.array("v")))
        edges = merged.select(ends.alias("a"), F.col("root").alias("b")).filter("a <> b")
        del stars, near, above, merged
        release(edges.sparkSession)  # every round shuffles; only its last links are needed
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
