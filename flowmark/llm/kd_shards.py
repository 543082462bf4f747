"""Shards of near equal bytes by a k-d tree over metadata.

The tree starts with one node for all shards. Each round cuts every node with more than one shard
along its widest dimension, at the weighted quantile that gives both sides the bytes their shards
have room for; with two equal sides that is the weighted median. All nodes of a round are cut
together: their rows are range partitioned by node and dimension, and only totals per range leave
the tasks. Equal texts are one weighted point, so they stay together.

Points that weigh a notable part of a shard would make cuts uneven. There can only be a bounded number
of them; they are placed first, the heaviest into the emptiest shard, and the tree fills up the room
they leave. Only a group of equal texts for which no shard has room is divided between shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.functions.durable import durable
from flowmark.llm.common import known_rows, running_total

#: Groups over this part of a shard are placed one by one: at most this many times the shards.
HEAVY_PART = 128
#: Bytes that count for a row besides its text.
ROW_BYTES = 8


def _dimension(docs: DataFrame, name: str) -> Column:
    """A column as a place on an axis; text is spread by a hash, null comes before all."""
    kind = docs.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        column = column.cast("double")
        column = F.when(~F.isnan(column), column)
    elif isinstance(kind, (T.TimestampType, T.DateType)):
        column = column.cast("timestamp").cast("double")
    else:
        column = F.crc32(column.cast("string")).cast("double")
    return F.coalesce(column, F.lit(-1.0))


def _place_heavy(heavy: list, target: float, n_shards: int):
    """Where heavy groups go: ``(digest, first rank, end rank, shard)``, and the room left."""
    room = [target] * n_shards
    emptiest = [(-target, s) for s in range(n_shards)]
    parts = []
    for group in sorted(heavy, key=lambda g: (-g["weight"], bytes(g["digest"]))):
        each, done, n = group["weight"] / group["n"], 0, group["n"]
        while done < n:
            left, shard = heapq.heappop(emptiest)
            fits = n - done if (n - done) * each <= -left else max(1, int(-left // each))
            parts.append((bytes(group["digest"]), done, done + fits, shard))
            room[shard] -= fits * each
            heapq.heappush(emptiest, (-room[shard], shard))
            done += fits
    return parts, room


def _cut_rounds(points: DataFrame, dims: list[str], room: list[float]) -> DataFrame:
    """``digest`` and ``shard`` of every light point."""
    spark = points.sparkSession
    spans = {0: (0, len(room))}
    points = points.withColumn("node", F.lit(0))
    widths = None
    room = [max(r, 0.0) for r in room]
    while any(hi - lo > 1 for lo, hi in spans.values()):
        points = durable(points)
        stats = points.groupBy("node").agg(
            F.sum("weight").alias("weight"),
            *[F.min(d).alias(f"min_{d}") for d in dims],
            *[F.max(d).alias(f"max_{d}") for d in dims],
        )
        nodes = {r["node"]: r for r in stats.collect()}  # at most one row per shard
        if not nodes:
            break
        width = lambda r, d: r[f"max_{d}"] - r[f"min_{d}"]
        widths = widths or {d: width(nodes[0], d) or 1.0 for d in dims}
        plan, following = [], {}
        for node, (lo, hi) in spans.items():
            mid = (lo + hi) // 2 if hi - lo > 1 else hi
            following[2 * node + 1] = (lo, mid)
            if mid < hi:
                following[2 * node + 2] = (mid, hi)
            if node not in nodes:
                continue
            widest = max(dims, key=lambda d: width(nodes[node], d) / widths[d])
            all_room = sum(room[lo:hi])
            part = sum(room[lo:mid]) / all_room if all_room else (mid - lo) / (hi - lo)
            # what is ahead of the cut, by the middle of a point, goes to the left
            cut = nodes[node]["weight"] * part if mid < hi else float("inf")
            plan.append((node, dims.index(widest), cut))
        axis = F.array(*dims)[F.col("axis")]
        cut = (
            points.join(known_rows(spark, plan, "node int, axis int, cut double"), "node")
            .withColumn("place", axis)
            .select("digest", "weight", *dims, "node", "cut", "place")
        )
        cut = running_total(cut, "node", ["place", "digest"], "weight", "ahead")
        left = F.col("ahead") + F.col("weight") / 2 <= F.col("cut")
        points = cut.select(
            "digest",
            "weight",
            *dims,
            (2 * F.col("node") + F.when(left, 1).otherwise(2)).cast("int").alias("node"),
        )
        spans = following
    shards = known_rows(spark, [(n, lo) for n, (lo, _) in spans.items()], "node int, shard int")
    return points.join(shards, "node").select("digest", "shard")


def kd_shards(
    docs: DataFrame,
    dims: Sequence[str],
    n_shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    Either the number of shards or the bytes a shard should have are given. The size of a row is that
    of its text in UTF-8 and ``ROW_BYTES``; a null text has none. ``slot`` numbers the rows of a
    shard from 0 by id. Null metadata are ordered first, ties by the digest of the text. An empty
    table gives no rows, and shards may stay empty when there are fewer texts than shards.
    """
    spark: SparkSession = docs.sparkSession
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give either n_shards or target_bytes")
    axes = [f"d{i}" for i in range(len(dims))]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(  # numbered and written at once, so the numbers stay
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            *[_dimension(docs, name).alias(axis) for axis, name in zip(axes, dims)],
        )
    )
    groups = durable(
        rows.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("size").alias("weight"),
            *[F.min(a).alias(a) for a in axes],
        )
    )
    total = groups.agg(F.sum("weight")).first()[0] or 0
    if n_shards is None:
        n_shards = max(1, -(-total // target_bytes))
    target = total / n_shards
    heavy = F.col("weight") > target / HEAVY_PART
    # fewer than HEAVY_PART * n_shards rows, by their weight
    parts, room = _place_heavy(
        groups.filter(heavy).select("digest", "n", "weight").collect(), target, n_shards
    )
    whole = {}
    for digest, *_ in parts:
        whole[digest] = whole.get(digest, 0) + 1
    together = [(d, s) for d, _, _, s in parts if whole[d] == 1]
    divided = [p for p in parts if whole[p[0]] > 1]
    light = groups.filter(~heavy).select("digest", "weight", *axes)
    shards = _cut_rounds(light, axes, room)
    placed = shards.unionByName(known_rows(spark, together, "digest binary, shard int"))
    columns = ["doc_id", "row", "size", "text_crc32", "shard"]
    if divided:
        names = known_rows(
            spark, [(d, i) for i, d in enumerate(sorted({p[0] for p in divided}))], "digest binary, g int"
        )
        ranks = running_total(
            rows.join(names, "digest").withColumn("one", F.lit(1)), "g", ["row"], "one", "rank"
        )
        ranges = known_rows(spark, divided, "digest binary, lo long, hi long, shard int")
        spread = ranks.join(ranges, "digest").filter("rank >= lo AND rank < hi").select(*columns)
        result = rows.join(placed, "digest").select(*columns).unionByName(spread)
    else:
        result = rows.join(placed, "digest").select(*columns)
    return running_total(
        result.withColumn("one", F.lit(1)), "shard", ["doc_id", "row"], "one", "slot"
    ).drop("one")
