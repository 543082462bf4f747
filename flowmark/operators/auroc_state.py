"""AUROC as an interval that holds it, from counts by bins of the score, mergeable over days and tables.

A state has a row for each bin: how many positive and negative rows it holds, and its least and greatest score. Pairs
of rows in different bins are decided; pairs inside a bin are not, unless all its scores are equal, so the AUROC
lies between what it would be if all of them were lost and all won. Bins that leave most pairs undecided are split
by reading the rows again, until the interval is as narrow as asked for. A score that many rows share
gets a bin of its own, in which nothing is undecided.

Rows without a label, and null scores, do not count; NaN is the greatest score. The driver holds the edges of the
bins of every identity, some thousand numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmark.functions.durable import durable, local_table
from flowmark.functions.ship import ship

#: Bins at first, parts a bin is split into, and rounds of splitting.
BINS, PARTS, ROUNDS = 256, 64, 8
#: Width of the interval, unless a call gives its own.
WIDTH = 1e-4

Edges = dict[str, np.ndarray]


def _named(by: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in by])) if by else F.lit("{}")


def scored_rows(df: DataFrame, score: Column, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows in the form of this module: ``by``, ``identity``, ``score`` and ``positive``."""
    rows = df.select(*by, _named(by).alias("identity"), score.cast("double").alias("score"), positive.alias("positive"))
    return rows.filter(F.col("score").isNotNull() & F.col("positive").isNotNull())


def _edges(values: Sequence[float]) -> list[float]:
    """Edges from quantiles: a value that comes twice gets a bin of its own."""
    out = set()
    for before, value in zip([None, *values], values):
        out.add(value)
        if before == value:
            out.add(float(np.nextafter(value, -np.inf)))
    return sorted(out)


def _quantiles(rows: DataFrame, keys: Sequence[str], parts: int) -> list:
    shares = [i / parts for i in range(1, parts)]
    cuts = F.percentile_approx("score", [float(x) for x in shares], F.lit(20 * parts)).alias("cuts")
    return rows.filter(~F.isnan("score")).groupBy(*keys).agg(cuts).collect()  # a row per identity or bin to be split


def first_edges(rows: DataFrame, bins: int = BINS) -> Edges:
    """Edges of bins with about as many rows each, by identity."""
    return {r["identity"]: np.array(_edges(r["cuts"])) for r in _quantiles(rows, ["identity"], bins)}


def _binned(rows: DataFrame, edges: Edges) -> DataFrame:
    """``bin``: the number of edges below the score."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(edges)

    @F.arrow_udf("int")
    def place(identity: pa.Array, score: pa.Array) -> pa.Array:
        values, out = score.to_numpy(zero_copy_only=False), np.zeros(len(score), dtype=np.int32)
        names = identity.dictionary_encode()
        at = names.indices.to_numpy(zero_copy_only=False)
        for number, name in enumerate(names.dictionary.to_pylist()):
            own = at == number
            out[own] = np.searchsorted(shared.value.get(name, np.zeros(0)), values[own], side="left")
        return pa.array(out)

    return rows.withColumn("bin", place("identity", "score"))


def _counted(binned: DataFrame, by: Sequence[str]) -> DataFrame:
    return binned.groupBy(*by, "identity", "bin").agg(
        F.count_if("positive").alias("pos"),
        F.count_if(~F.col("positive")).alias("neg"),
        F.min("score").alias("least"),
        F.max("score").alias("most"),
    )


def histogram(rows: DataFrame, edges: Edges, by: Sequence[str] = ()) -> DataFrame:
    """The state of ``rows`` under ``edges``."""
    return _counted(_binned(rows, edges), by)


def merged(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """States under the same edges as one."""
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    return whole.groupBy(*by, "identity", "bin").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.min("least").alias("least"), F.max("most").alias("most")
    )


def _open_pairs() -> Column:
    """Pairs of a bin that are not decided."""
    equal = F.col("least") == F.col("most")
    return F.when(equal, 0.0).otherwise(F.col("pos").cast("double") * F.col("neg"))


def bounds(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``lower``, ``upper`` and the ``width`` between them, per identity; null where only one side has rows."""
    below = Window.partitionBy("identity").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(below), F.lit(0))
    tied = F.when(F.col("least") == F.col("most"), F.col("pos").cast("double") * F.col("neg") / 2).otherwise(0.0)
    summed = state.withColumns({"__won": won + tied, "__open": _open_pairs()}).groupBy(*by, "identity").agg(
        F.sum("__won").alias("__won"), F.sum("__open").alias("__open"),
        F.sum("pos").cast("double").alias("__pos"), F.sum("neg").cast("double").alias("__neg"),
    )
    pairs = F.when((F.col("__pos") > 0) & (F.col("__neg") > 0), F.col("__pos") * F.col("__neg"))
    lower, width = F.col("__won") / pairs, F.col("__open") / pairs
    return summed.select(*by, lower.alias("lower"), (lower + width).alias("upper"), width.alias("width"))


def _widest(state: DataFrame, width: float) -> DataFrame:
    """The bins to be split: those with the most open pairs, until what the others leave open is half the width."""
    heavy = Window.partitionBy("identity").orderBy(F.desc("__open"), "bin")
    all_of = Window.partitionBy("identity")
    sized = state.withColumn("__open", _open_pairs()).withColumns({
        "__rest": F.sum("__open").over(heavy.rowsBetween(0, Window.unboundedFollowing)),
        "__pairs": F.sum("pos").over(all_of).cast("double") * F.sum("neg").over(all_of),
        "__all": F.sum("__open").over(all_of),
    })
    chosen = (F.col("__all") > width * F.col("__pairs")) & (F.col("__rest") > width / 2 * F.col("__pairs")) & (F.col("__open") > 0)
    return sized.filter(chosen).select("identity", "bin")


def fit_state(
    rows: DataFrame, by: Sequence[str] = (), width: float = WIDTH, bins: int = BINS
) -> tuple[DataFrame, Edges]:
    """A state whose interval is at most ``width`` wide, and its edges, under which other rows can be counted.

    ``rows`` (see :func:`scored_rows`) are read once for the edges and once for the counts; every further round reads
    them twice, for the edges inside the bins it splits and for the counts.
    """
    edges = first_edges(rows, bins)
    state = durable(histogram(rows, edges, by))
    for _ in range(ROUNDS):
        split = [(r["identity"], r["bin"]) for r in _widest(state, width).collect()]  # bins
        if not split:
            break
        wanted = F.broadcast(local_table(rows.sparkSession, split, "identity string, bin int"))
        inside = _binned(rows, edges).join(wanted, ["identity", "bin"])
        new: dict[str, set[float]] = {}
        for r in _quantiles(inside, ["identity", "bin"], PARTS):
            new.setdefault(r["identity"], set()).update(_edges(r["cuts"]))
        edges = {name: np.unique([*own, *new.get(name, ())]) for name, own in edges.items()}
        state = durable(histogram(rows, edges, by))
    return state, edges
