"""The trie of conversation prefixes, and totals over its subtrees by parallel tree contraction.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and it is
named by the smallest of them and its depth. The nodes named by one conversation are a path downwards.

1. Rows are numbered by range partitions. The prefix up to a turn is known by sums of 32-bit hashes of
   (depth, role, text), added up in blocks of ``BLOCK`` turns, so that no conversation is ordered in one
   task. Rows with the same sums at the same depth form a node. Every node then checks that its members have
   the same last turn and the same prefix before it; by induction they have equal prefixes.
2. Contraction, in rounds: *compress* removes all nodes with one child left, first the runs inside a block
   of a path by a window over that block, then what is left by pointers of doubling reach. *Rake* removes all
   leaves and adds their totals to their parents, summed up before they are shuffled. Every round at least
   halves the nodes, however deep or crooked the trie is.
3. Expansion, in reverse order: a removed node's total is its own weight down to the node that its pointer
   ended at, and that node's total.

Rows of a conversation come by turn (null first), those of one turn by role and the digest of their text. Rows
without a conversation id have no part in it. Null roles and texts count as empty. Repeated rows are turns of
their own. A table without rows has no nodes, not even a root. Other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import running_total, settled

#: Turns of a conversation that one task adds up in order.
BLOCK = 4096
SUMS = ("h0", "h1", "h2", "h3")
UPPER = tuple(f"{h}_up" for h in SUMS)
DIGEST = ("d0", "d1")
NODE = ("conv", "depth")
TOTALS = ("leaves", "saved")
EDGES = tuple(f"{t}_edge" for t in TOTALS)
WAYS = tuple(f"{t}_way" for t in TOTALS)


def _none():
    return F.lit(0).cast("long")


def numbered(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv``, ``depth`` (from 1), the digest of role and text, and ``size``, the text's UTF-8 bytes."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = settled(turns).filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).isNotNull().alias("known"),
        F.coalesce(F.col(turn_col).cast("long"), _none()).alias("turn"),
        role.alias("role"),
        digest.alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
        F.lit(1).alias("one"),
        # equal rows may lie in several ranges
        F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).alias("salt"),
    )
    placed = running_total(rows, "conv", ["known", "turn", "role", "digest", "salt"], "one", "before")
    parts = [F.conv(F.substring("digest", i, 15), 16, 10).cast("long").alias(d) for i, d in zip((1, 16), DIGEST)]
    return placed.select("conv", (F.col("before") + 1).alias("depth"), *parts, "size")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Numbered turns of conversations that share their beginnings: the first turns of conversation
    ``c - c % family``, fewer than ``most`` and as many as a hash of ``c`` says, then ``c``'s own after as many."""
    turns = durable(turns)
    lengths = turns.groupBy("conv").agg(F.count("*").alias("n"))
    hashed = F.crc32(F.col("conv").cast("string")) % most
    plan = lengths.select("conv", hashed.alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    plan = durable(
        plan.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .select("conv", "base", "h", F.least("h", F.coalesce("base_n", _none())).alias("given"))
    )
    own = turns.join(plan, "conv").filter("depth > h")
    own = own.withColumn("depth", F.col("depth") - F.col("h") + F.col("given")).select(*turns.columns)
    # fewer than ``most`` rows of a conversation, each for at most 2 * family - 1 others
    first = turns.filter(F.col("depth") < most).withColumnRenamed("conv", "base")
    given = first.join(plan, "base").filter("depth <= given").select(*turns.columns)
    return own.unionByName(given)


def with_prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Numbered turns, and one row of depth 0 for each of ``convs``, with the sums that tell their prefixes
    apart, those of the prefix before the last turn, and ``last``."""
    start = convs.select("conv", *[_none().alias(c) for c in ("depth", *DIGEST, "size")])
    rows = start.unionByName(turns.select(*start.columns)).withColumn("block", F.expr(f"depth div {BLOCK}"))
    for i, h in enumerate(SUMS):
        own = F.xxhash64(F.lit(i), "depth", *DIGEST).bitwiseAND(F.lit((1 << 32) - 1))
        rows = rows.withColumn(f"{h}_own", F.when(F.col("depth") > 0, own).otherwise(_none()))
    rows = durable(rows)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.max("depth").alias("end"), *[F.sum(f"{h}_own").alias(h) for h in SUMS])
    blocks = blocks.select(
        "conv", "block",
        F.max("end").over(Window.partitionBy("conv")).alias("end"),
        *[F.coalesce(F.sum(h).over(earlier), _none()).alias(f"{h}_ahead") for h in SUMS],
    )
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = {h: F.col(f"{h}_ahead") + F.sum(f"{h}_own").over(inside) for h in SUMS}
    return rows.join(blocks, ["conv", "block"]).withColumns(whole).select(
        *start.columns, *SUMS,
        *[(F.col(h) - F.col(f"{h}_own")).alias(up) for h, up in zip(SUMS, UPPER)],
        (F.col("depth") == F.col("end")).alias("last"),
    )


def nodes_of(prefixes: DataFrame) -> DataFrame:
    """A row per node: name (``conv``, ``depth``), sums, sums of its parent, ``n_convs`` and ``size``."""
    same = [*DIGEST, "size", *UPPER]
    found = prefixes.groupBy("depth", *SUMS).agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in same],
        *[F.max(c).alias(f"{c}_most") for c in same],
    )
    differ = F.lit(False)
    for c in same:
        differ = differ | (F.col(c) != F.col(f"{c}_most"))
    # a collision of hashes ends the run rather than join two nodes
    checked = F.when(differ, F.raise_error(F.lit("different prefixes have equal sums")).cast("long")).otherwise(F.col("n_convs"))
    return found.select("conv", "depth", *SUMS, *UPPER, checked.alias("n_convs"), "size")


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent`` (its conversation; null for the root) and ``n_children``."""
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"),
        *[F.col(h).alias(up) for h, up in zip(SUMS, UPPER)],
        F.col("conv").alias("parent"),
    )
    below = nodes.join(above, ["depth", *UPPER], "left").select("conv", "depth", "parent", "n_convs", "size")
    below = durable(below)
    children = below.filter("parent IS NOT NULL").groupBy(
        F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count("*").alias("n_children"))
    counted = below.join(children, list(NODE), "left")
    return counted.withColumn("n_children", F.coalesce("n_children", _none()))


def _runs(alive: DataFrame) -> DataFrame:
    """``alive`` with ``chain``: has one child left, which is the next of its path and block; ``to_depth``: the
    first node from here down the path that is no such; and the weight on the way to it, its own left out."""
    path = Window.partitionBy("conv", "block").orderBy(F.desc("depth"))
    so_far = path.rowsBetween(Window.unboundedPreceding, 0)
    below = F.lag(F.struct("up_conv", "up_depth", *EDGES)).over(path)
    marked = alive.withColumn("block", F.expr(f"depth div {BLOCK}")).withColumn("below", below)
    follows = (F.col("below.up_conv") == F.col("conv")) & (F.col("below.up_depth") == F.col("depth"))
    marked = marked.withColumn("chain", F.coalesce((F.col("kids") == 1) & follows, F.lit(False)))
    stop = F.last(F.when(~F.col("chain"), F.col("depth")), ignorenulls=True).over(so_far)
    marked = marked.withColumn("to_depth", stop).withColumns(
        {way: F.when(F.col("chain"), F.col(t) + F.col(f"below.{edge}")) for t, edge, way in zip(TOTALS, EDGES, WAYS)}
    )
    run = Window.partitionBy("conv", "block", "to_depth").orderBy(F.desc("depth"))
    run = run.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumns({way: F.sum(way).over(run) for way in WAYS}).drop("block", "below")


def _jumps(alive: DataFrame) -> DataFrame:
    """Nodes with one child left, with the first node below them that has not, and the weight on the way."""
    single = alive.filter("kids = 1")
    child = alive.select(
        F.col("conv").alias("to_conv"),
        F.col("depth").alias("to_depth"),
        F.col("up_conv").alias("conv"),
        F.col("up_depth").alias("depth"),
        *[F.col(edge).alias(way) for edge, way in zip(EDGES, WAYS)],
    )
    jumps = durable(
        single.join(child, list(NODE)).withColumns({way: F.col(t) + F.col(way) for t, way in zip(TOTALS, WAYS)})
    )
    while True:
        onward = jumps.select(
            F.col("conv").alias("to_conv"),
            F.col("depth").alias("to_depth"),
            F.col("to_conv").alias("next_conv"),
            F.col("to_depth").alias("next_depth"),
            *[F.col(way).alias(f"{way}_next") for way in WAYS],
        )
        further = jumps.join(onward, ["to_conv", "to_depth"], "left")
        further = durable(further)
        if further.filter("next_conv IS NOT NULL").isEmpty():
            return jumps
        jumps = further.select(
            *[c for c in jumps.columns if c not in ("to_conv", "to_depth", *WAYS)],
            F.coalesce("next_conv", "to_conv").alias("to_conv"),
            F.coalesce("next_depth", "to_depth").alias("to_depth"),
            *[(F.col(way) + F.coalesce(f"{way}_next", _none())).alias(way) for way in WAYS],
        )


def _closed_up(rest: DataFrame, removed: DataFrame) -> DataFrame:
    """``rest`` with the ends of removed chains hung where the tops of the chains hung."""
    tops = removed.groupBy(F.col("to_conv").alias("conv"), F.col("to_depth").alias("depth")).agg(
        F.min_by(F.struct("up_conv", "up_depth", *EDGES, *WAYS), "depth").alias("top")
    )
    moved = F.col("top").isNotNull()
    return rest.join(tops, list(NODE), "left").select(
        *NODE,
        *[F.when(moved, F.col(f"top.{c}")).otherwise(F.col(c)).alias(c) for c in ("up_conv", "up_depth")],
        "kids",
        *TOTALS,
        *[
            F.when(moved, F.col(f"top.{edge}") + F.col(f"top.{way}")).otherwise(F.col(edge)).alias(edge)
            for edge, way in zip(EDGES, WAYS)
        ],
    )


def _raked(alive: DataFrame) -> DataFrame:
    """Nodes that are no leaves, after the totals of their leaves are added to them."""
    given = alive.filter("kids = 0 AND up_conv IS NOT NULL").groupBy(
        F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth")
    ).agg(F.count("*").alias("gone"), *[F.sum(F.col(t) + F.col(e)).alias(f"{t}_in") for t, e in zip(TOTALS, EDGES)])
    return alive.filter("kids > 0").join(given, list(NODE), "left").select(
        *NODE, "up_conv", "up_depth",
        (F.col("kids") - F.coalesce("gone", _none())).alias("kids"),
        *[(F.col(t) + F.coalesce(f"{t}_in", _none())).alias(t) for t in TOTALS],
        *EDGES,
    )


def subtree_totals(tree: DataFrame) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over the subtree of every node (``conv``, ``depth``, ``up_conv``,
    ``up_depth``, ``kids`` and the two weights), its top included."""
    alive = durable(tree.select(*NODE, "up_conv", "up_depth", "kids", *TOTALS, *[_none().alias(e) for e in EDGES]))
    known, removed = [], []
    while True:
        marked = durable(_runs(alive))
        counts = marked.agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("chain"), 1)).alias("chained"),
            F.count(F.when(~F.col("chain") & (F.col("kids") == 1), 1)).alias("single"),
        ).first()
        if counts["n"] == 0:
            break
        if counts["chained"]:
            chained = marked.filter("chain").withColumn("to_conv", F.col("conv"))
            removed.append(chained)
            alive = durable(_closed_up(marked.filter("NOT chain").select(*alive.columns), chained))
        if counts["single"]:  # chains that go on in another path or block
            jumps = _jumps(alive)
            removed.append(jumps)
            alive = durable(_closed_up(alive.filter("kids <> 1"), jumps))
        known.append(alive.filter("kids = 0").select(*NODE, *TOTALS))
        alive = durable(_raked(alive))
    if not known:
        return tree.select(*NODE, *TOTALS)
    totals = known[0]
    for table in known[1:]:
        totals = totals.unionByName(table)
    for table in reversed(removed):
        below = totals.select(
            F.col("conv").alias("to_conv"), F.col("depth").alias("to_depth"), *[F.col(t).alias(f"{t}_to") for t in TOTALS]
        )
        found = table.join(below, ["to_conv", "to_depth"]).select(
            *NODE, *[(F.col(way) + F.col(f"{t}_to")).alias(t) for t, way in zip(TOTALS, WAYS)]
        )
        totals = totals.unionByName(durable(found))
    return totals


def prefix_trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of numbered ``turns`` (see :func:`numbered`) of all ``convs``, and for each of them
    the node at which it ends (``conv``, ``depth``, ``member``).

    Nodes have ``conv``, ``depth``, ``parent``, ``n_convs``, ``n_children``, ``leaves`` and ``saved``: bytes of last texts,
    each as often as the node has further members, over the whole subtree.
    """
    prefixes = durable(with_prefixes(turns, convs))
    nodes = durable(nodes_of(prefixes))
    tree = durable(linked(nodes))
    weighted = tree.select(
        *NODE,
        F.col("parent").alias("up_conv"),
        F.when(F.col("parent").isNotNull(), F.col("depth") - 1).alias("up_depth"),
        F.col("n_children").alias("kids"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    whole = tree.join(subtree_totals(weighted), list(NODE))
    ends = prefixes.filter("last").select(F.col("conv").alias("member"), "depth", *SUMS)
    ends = ends.join(nodes.select("conv", "depth", *SUMS), ["depth", *SUMS]).select("conv", "depth", "member")
    return whole.drop("size"), ends


def member_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined members that end at each node.

    A digest is made in order, so one task reads all members that end at a node; it streams them, and holds
    a batch of ids and the digest so far, whatever their number.
    """
    ship(ends.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, sha256()
        for batch in batches:
            done = []
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            first = 0
            for last in _group_ends(columns[0], columns[1]):
                own = (int(columns[0][first]), int(columns[1][first]))
                text = ",".join(map(str, columns[2][first:last].tolist()))
                if own == node:
                    digest.update(f",{text}".encode())
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = own, sha256(text.encode())
                first = last
            yield _digest_batch(done)
        if node is not None:
            yield _digest_batch([(*node, digest.hexdigest())])

    dealt = ends.select("conv", "depth", "member").repartition("conv", "depth")
    return dealt.sortWithinPartitions("conv", "depth", "member").mapInArrow(
        digests, "conv long, depth long, ends_sha256 string"
    )


def _group_ends(conv, depth) -> list[int]:
    """Ends of the runs of equal nodes in a batch."""
    change = (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])
    return [*(change.nonzero()[0] + 1).tolist(), len(conv)] if len(conv) else []


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv", "depth", "ends_sha256"]
    )
