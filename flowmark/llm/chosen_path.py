"""Near-duplicates by a chosen-path set similarity join.

1. Every text becomes its set of hashed word shingles; equal sets become one class, so copies take part
   once. A class has a sketch: the minima of its set under 64 hash functions.
2. Trees: in every node a class goes down ``BRANCHES`` branches, each named by a position of the sketch
   that the node chooses and by the minwise token found there. Two sets of similarity s share a branch
   with probability s, so at 0.8 a tree of three branches loses a pair with probability below 0.01 however
   deep it is, and ``TREES`` independent ones with less than 1e-6. Nodes of few classes
   are compared exhaustively by their sketches; large ones branch on, unless few of their pairs are
   not connected yet.
3. What the nodes report is a forest of classes whose sketches agree in half of the positions; at a
   similarity of 0.8 fewer agree with probability below 1e-7. Its components hold all links
   found. The full sets of a component are brought together once, and links are confirmed on them.
   Components of many classes are spread over pairs of blocks, so that every task is bounded.
4. Components of the confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmark.functions.durable import durable
from flowmark.functions.ship import ship
from flowmark.llm.common import gathered, settled, texts
from flowmark.llm.components import components
from flowmark.llm.hashing import mix, runs_of, text_blocks, word_hashes, word_spans

POSITIONS = 64
TREES = 3
BRANCHES = 3
#: Depths at which nodes branch; each has its own positions of the sketch.
DEPTH = 4
#: Classes of a node that are compared exhaustively, and pairs of classes of different components for
#: which a larger node is compared and does not branch.
SMALL_NODE = 32
NODE_PAIRS = 200_000
#: Further such pairs for each class of a node: to branch costs more than so many comparisons.
ROW_PAIRS = 1_000
#: Classes of a node in one task.
PART = 2_000
#: Sketch positions that have to agree for a pair to be looked at on full sets.
AGREE = 32
#: Classes of a component confirmed in one task, and sets that one is compared with at once.
BLOCK = 1500
TOGETHER = 256
#: Rows of small tables that one task reads.
NODE_ROWS = 200_000

_SEEDS = np.random.default_rng(77).integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(
    2
) + np.uint64(1)
SKETCHED = "doc_id long, row long, n_shingles long, digest binary, sketch binary"


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; none without words."""
    for _, data, offsets in text_blocks(column):
        starts, ends, before = word_spans(data, offsets)
        words = word_hashes(data, starts, ends, lower=True)
        runs = runs_of(words, k)
        for lo, hi in zip(before[:-1], before[1:]):
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            elif hi > lo:
                yield runs_of(words[lo:hi], hi - lo) ^ np.uint64(hi - lo)
            else:
                yield words[:0]


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minima under every hash function, for sets that are not empty."""
    out = np.empty((len(sets), POSITIONS), dtype=np.uint32)
    if sets:
        flat = np.concatenate(sets)
        sizes = np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        for i, seed in enumerate(_SEEDS):
            out[:, i] = np.minimum.reduceat(flat * seed, starts) >> np.uint64(32)
    return out


def _children(nodes: np.ndarray, sketches: np.ndarray, depth: int) -> list[np.ndarray]:
    """The branches a class takes from its node: hashes of the node, a position and its token."""
    share = POSITIONS // DEPTH
    out = []
    for branch in range(BRANCHES):
        chosen = mix(nodes + np.uint64(branch * 2 + 1))
        # the branches of a node choose from parts of their own, so they never choose alike
        part = share // BRANCHES
        at = depth * share + branch * part + (chosen % np.uint64(part)).astype(np.int64)
        token = sketches[np.arange(len(nodes)), at].astype(np.uint64)
        out.append(mix(chosen ^ mix(token + (at.astype(np.uint64) << np.uint64(40)))))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, POSITIONS)


def _member_batches(nodes: list[np.ndarray], **columns: np.ndarray) -> pa.RecordBatch:
    """The branches of classes, each with what is known of its class."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(nodes).view(np.int64))]
        + [pa.array(np.tile(column, len(nodes))) for column in columns.values()],
        names=["node", *columns],
    )


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``pairs`` that connect what was not connected before."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _agreeing(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a[i], b[i]`` of rows have sketches that agree enough."""
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 65536):
        x, y = a[at : at + 65536], b[at : at + 65536]
        # few positions tell most pairs apart
        some = np.flatnonzero((sketches[x, :16] == sketches[y, :16]).any(1))
        out[at + some] = (sketches[x[some]] == sketches[y[some]]).sum(1) >= AGREE
    return out


def _alike(nodes: np.ndarray, sketches: np.ndarray, small: int) -> list[tuple[int, int]]:
    """Pairs of rows of a node (rows come by node) with sketches alike: all pairs of nodes with at most
    ``small`` rows, and each row with the first one of its node."""
    first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(nodes)]]))
    head, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    left = head + size - np.arange(len(nodes)) - 1  # rows after it in its node
    rows = np.flatnonzero(np.arange(len(nodes)) > head)
    pairs = [(head[rows], rows)]
    rows = np.flatnonzero((size <= small) & (np.arange(len(nodes)) > head))
    for step in range(1, small):
        rows = rows[left[rows] >= step]
        pairs.append((rows, rows + step))
    found = [(a[same], b[same]) for a, b in pairs for same in [_agreeing(sketches, a, b)]]
    a, b = (np.concatenate(side).tolist() for side in zip(*found))
    return list(zip(a, b))


def _across(nodes: np.ndarray, groups: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows of a node with sketches alike and different groups, as far as they connect groups.

    Rows come by node and group. Those of a node's largest group are not compared with each other."""
    number, groups = np.unique(groups, return_inverse=True)
    parent = np.arange(len(number))
    out = []
    first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    for start, end in zip(first.tolist(), [*first[1:].tolist(), len(nodes)]):
        own = groups[start:end]
        kinds, counts = np.unique(own, return_counts=True)
        largest = kinds[counts.argmax()]
        every = np.arange(start, end)
        for x in every[own != largest].tolist():
            others = every[(own == largest) | (every < x)]
            others = others[parent[groups[others]] != parent[groups[x]]]
            for y in others[_agreeing(sketches, np.full(len(others), x), others)].tolist():
                low, high = sorted((parent[groups[x]], parent[groups[y]]))
                if low != high:
                    parent[parent == high] = low
                    out.append((x, y))
    return out


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by node, cut so that a node is whole."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node").to_numpy()
        cut = int(np.searchsorted(nodes, nodes[-1]))
        if kept and cut == 0 and kept[-1].column("node")[-1].as_py() == nodes[-1]:
            kept.append(batch)
            continue
        kept.append(batch.slice(0, cut))
        yield pa.Table.from_batches(kept)
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def _links(classes: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """Classes of pairs of rows, without what they connect already."""
    number, at = np.unique(classes, return_inverse=True)
    ends = np.array(_forest(len(number), ((at[a], at[b]) for a, b in pairs)), dtype=np.int64)
    ends = ends.reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(number[ends[:, 0]]), pa.array(number[ends[:, 1]])], names=["a", "b"]
    )


def _compare_nodes(small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_node(batches):
            if table.num_rows:
                nodes, sketches = table.column("node").to_numpy(), _matrix(table.column("sketch"))
                yield _links(table.column("cls").to_numpy(), _alike(nodes, sketches, small))

    return run


def _compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_node(batches):
        if table.num_rows:
            nodes, sketches = table.column("node").to_numpy(), _matrix(table.column("sketch"))
            pairs = _across(nodes, table.column("component").to_numpy(), sketches)
            yield _links(table.column("cls").to_numpy(), pairs)


def _candidates(classes: DataFrame) -> DataFrame:
    """Links between classes with sketches alike that share a node of a tree.

    First the nodes below the roots: small ones are compared exhaustively, in large ones every class with
    the first. That joins the bulk of a large group of near copies, whose members no tree could tell
    apart, by one link each. From there on only classes of different components are compared: in
    nodes with few such pairs all of them, while nodes with many branch on.

    The nodes that are to be compared are gathered first, from all rounds or depths, and compared in one
    step. ``classes`` has to be a checkpoint.
    """
    branching = TREES * BRANCHES
    rows = classes.count()
    classes = gathered(classes, rows, NODE_ROWS)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, ids = _matrix(batch.column("sketch")), batch.column("cls").to_numpy()
            trees = mix(np.arange(1, TREES + 1, dtype=np.uint64))
            nodes = [
                child
                for tree in trees
                for child in _children(np.full(len(ids), tree), sketches, 0)
            ]
            yield _member_batches(nodes, cls=ids)

    def down(depth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nodes = batch.column("node").to_numpy().view(np.uint64)
                known = {c: batch.column(c).to_numpy() for c in ("cls", "component")}
                sketches = _matrix(batch.column("sketch"))
                yield _member_batches(_children(nodes, sketches, depth), **known)

        return run

    def by_node(members: DataFrame, *order: str) -> DataFrame:
        # the rows of a part of a node come together by hash and are sorted within a task
        with_sketch = members.join(classes, "cls").repartition("node")
        return with_sketch.sortWithinPartitions("node", *order, "cls")

    def sized(members: DataFrame) -> DataFrame:
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        return gathered(durable(members.join(sizes, "node")), rows * branching, NODE_ROWS)

    def part_of(node: Column, number: Column) -> Column:
        return F.when(number == 0, node).otherwise(F.xxhash64(node, number))

    members = gathered(
        durable(classes.mapInArrow(roots, "node long, cls long")), rows * branching, NODE_ROWS
    )
    members = stars = sized(members)
    dealt = []
    while True:
        # large nodes in parts: their rows meet the first of a part, the first ones meet each other next
        parts = F.ceil(F.col("size") / PART)
        place = part_of(F.col("node"), F.pmod(F.xxhash64("cls"), parts))
        dealt.append(stars.select(place.alias("node"), "cls"))
        large = stars.filter(F.col("size") > PART)
        if large.isEmpty():
            break
        firsts = large.groupBy("node", place.alias("part")).agg(F.min("cls").alias("cls"))
        # the first ones of a node meet in a node of their own
        stars = sized(firsts.select(F.xxhash64("node", F.lit(-len(dealt))).alias("node"), "cls"))
    star = by_node(reduce(DataFrame.unionByName, dealt))
    joined = components(star.mapInArrow(_compare_nodes(SMALL_NODE), "a long, b long"))
    joined = joined.select(F.col("v").alias("cls"), F.col("root").alias("component"))
    members = (
        members.filter(F.col("size") > SMALL_NODE)
        .select("node", "cls")
        .join(joined, "cls", "left")
        .withColumn("component", F.coalesce("component", "cls"))
    )
    dealt = []
    for depth in range(1, DEPTH + 1):
        most = rows * branching * BRANCHES ** (depth - 1)
        members = gathered(durable(members), most, NODE_ROWS)
        mixed = (
            members.groupBy("node", "component")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("node")
            .agg(
                F.sum("n").alias("size"),
                F.sum(F.col("n") * F.col("n")).alias("same"),
                F.max_by("component", "n").alias("largest"),
            )
            .withColumn("pairs", (F.col("size") * F.col("size") - F.col("same")) / 2)
            .filter("pairs > 0")
            .select("node", "size", "largest", "pairs")
        )
        members = gathered(durable(members.join(mixed, "node")), most, NODE_ROWS)
        few = (F.col("pairs") <= NODE_PAIRS + ROW_PAIRS * F.col("size")) | F.lit(depth == DEPTH)
        # of a large node the largest component is dealt out to parts, and all else goes to every part
        parts = F.ceil(F.col("size") / PART)
        own = F.array(F.pmod(F.xxhash64("cls"), parts))
        every = F.sequence(F.lit(0).cast("long"), parts - 1)
        number = F.explode(F.when(F.col("component") == F.col("largest"), own).otherwise(every))
        numbered = members.filter(few).select("node", "component", "cls", number.alias("part"))
        place = part_of(F.col("node"), F.col("part"))
        dealt.append(numbered.select(place.alias("node"), "component", "cls"))
        large = members.filter(~few).select("node", "component", "cls")
        if depth == DEPTH or large.isEmpty():
            break
        members = large.join(classes, "cls").mapInArrow(
            down(depth), "node long, cls long, component long"
        )
    across = by_node(reduce(DataFrame.unionByName, dealt), "component")
    across = across.mapInArrow(_compare_groups, "a long, b long")
    return joined.select(F.col("cls").alias("a"), F.col("component").alias("b")).unionByName(across)


def _confirm(similarity: float):
    """Function that links the sets of one block, or of two, where they are similar enough."""
    part, whole = int(round(similarity * 10_000)), 10_000

    def linked(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which of the sorted sets ``others`` are similar to ``one``; no set is empty."""
        sizes, flat = np.array([len(s) for s in others]), np.concatenate(others)
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        return both * whole >= part * (len(one) + sizes - both)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", ignore_index=True)
        sets = [np.frombuffer(s, dtype="<u8") for s in group["shingles"]]
        # a part of one block is only compared with the other block
        blocks, n = group["own"].to_numpy(), len(sets)
        apart = len(np.unique(blocks)) > 1
        sketches, sizes = _sketches(sets), np.array([len(s) for s in sets])
        parent = np.arange(n)
        out = []
        classes = group["cls"].to_numpy()
        order = np.argsort(-sizes, kind="stable")
        for at, i in enumerate(order):
            rest = order[at + 1 :]
            rest = rest[parent[rest] != parent[i]]
            if apart:
                rest = rest[blocks[rest] != blocks[i]]
            if not len(rest):
                continue
            # sets that come later are no larger
            rest = rest[sizes[rest] * whole >= part * sizes[i]]
            rest = rest[(sketches[rest] == sketches[i]).sum(1) >= AGREE]
            while len(rest):
                some = rest[:TOGETHER]
                for j in some[linked(sets[i], [sets[j] for j in some])]:
                    if parent[i] != parent[j]:
                        low, high = sorted((parent[i], parent[j]))
                        parent[parent == high] = low
                        out.append((classes[i], classes[j]))
                rest = rest[TOGETHER:]
                rest = rest[parent[rest] != parent[i]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row``, ``n_shingles``, ``component_id``, ``kept``.

    A-Z are lower-cased, words are what stands between ASCII white space. The set of a text has its
    distinct shingles of ``shingle_words`` words; a shorter text is one shingle, and a text without
    words (null, empty, blank) has none and is linked with nothing. Texts are linked when the Jaccard
    similarity of their full sets is at least ``similarity`` (0.8 or more, for which the trees are
    laid out). A group is what links connect; the row with the smallest id stays, null
    ids last, and of rows with one id one stays. No rows, no result rows.
    """
    if similarity < 0.8:
        raise ValueError("the trees are laid out for similarities of 0.8 and more")
    ship(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches, waiting = [], [], [], []

            def flush():
                made = iter(_sketches([s for s in waiting if len(s)]))
                sketches.extend(next(made).tobytes() if len(s) else None for s in waiting)
                waiting.clear()

            for s in shingle_sets(batch.column("text"), shingle_words):
                sizes.append(len(s))
                digests.append(
                    hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                )
                waiting.append(s)
                if len(waiting) == 256:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc_id", "row", "n_shingles", "digest", "sketch"],
            )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(batch.column("text"), shingle_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("cls", "component", "own", "blocks")]
                + [pa.array(found, pa.binary())],
                names=["cls", "component", "own", "blocks", "shingles"],
            )

    plain = texts(docs, id_col, text_col)
    sketched = durable(plain.mapInArrow(sketch, SKETCHED))
    classes = durable(
        sketched.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("row").alias("cls"), F.first("sketch").alias("sketch"))
    )
    near = components(_candidates(classes.select("cls", "sketch"))).select(
        F.col("v").alias("cls"), F.col("root").alias("component")
    )
    sizes = near.groupBy("component").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    dealt = near.join(sizes, "component").withColumn(
        "own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    )
    full = (
        plain.select(F.col("row").alias("cls"), "text")
        .join(dealt, "cls")
        .select("cls", "component", "own", "blocks", "text")
        .mapInArrow(sets, "cls long, component long, own int, blocks int, shingles binary")
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least("own", other).alias("low"), F.greatest("own", other).alias("high")
        ),
    )
    confirmed = (
        full.withColumn("pair", F.explode(pairs))
        .select("component", "pair.low", "pair.high", "own", "cls", "shingles")
        .groupBy("component", "low", "high")
        .applyInPandas(_confirm(similarity), "a long, b long")
    )
    roots = components(confirmed).select(F.col("v").alias("cls"), "root")
    grouped = durable(
        sketched.select("doc_id", "row", "n_shingles", "digest")
        .join(classes.select("digest", "cls"), "digest", "left")
        .join(roots, "cls", "left")
        .select("doc_id", "row", "n_shingles", F.coalesce("root", "cls", "row").alias("root"))
    )
    # a row without shingles is a group of its own; rows of classes are numbered by their least row
    first = F.min(F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "row"))
    heads = grouped.groupBy("root").agg(first.alias("first"))
    return grouped.join(heads, "root").select(
        "doc_id",
        "row",
        "n_shingles",
        F.col("first.doc_id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    docs = settled(docs)
    kept = near_duplicates(docs, shingle_words, similarity, id_col, text_col).filter("kept")
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    return numbered.join(kept.select(F.col("row").alias("__row")), "__row", "left_semi").drop("__row")
