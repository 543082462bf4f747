"""Deterministic class samples and train/test splits ordered by a seeded hash."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.fixed_values import (
    DATASET_2022,
    POLICY_CAP,
    POLICY_FULL,
    POLICY_REDUCTION,
    PROTECTED_CLASSES,
    REDUCTION,
    SEED,
    TRAIN_FRACTION,
)
from flowmark.functions.durable import null_safe_join, side_table
from flowmark.functions.keys import hash_bucket, seeded_hash, stable_key

#: Caps up to this size are cut by Spark's rank limit inside each input partition.
WINDOW_CAP = 1000
#: Hash prefixes a sample is narrowed down by: 4096 counts per class and level.
PREFIX_BITS = (12, 24, 36)
#: Rows of a class that one task may rank.
EDGE_ROWS = 500_000
#: Copies of one row that a task writes out at once.
COPY_CHUNK = 10_000

_HASH, _KEY, _TIE, _LEFT = "__hash", "__key", "__tie", "__left"


def _orderable(df: DataFrame, names: Sequence[str]) -> list[str]:
    nested = (T.MapType, T.VariantType, T.UserDefinedType)
    return [n for n in names if not isinstance(df.schema[n].dataType, nested)]


def _keyed(
    df: DataFrame,
    key_cols: Sequence[str],
    fallback_cols: Sequence[str] | None,
    tie_cols: Sequence[str] | None,
    seed: int,
    kind: str,
) -> DataFrame:
    """Add the sample order: hash of the key, the key, and a hash that orders equal keys."""
    ties = _orderable(df, [c for c in df.columns if c not in key_cols])
    if tie_cols is not None:
        ties = list(tie_cols)
    if not ties:
        tie = F.lit(0).cast("bigint")
    elif kind == "xxhash64":
        tie = F.xxhash64(*ties, F.lit(seed))
    else:
        tie = seeded_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in ties]), seed, kind)
    key = stable_key(key_cols, fallback_cols)
    return df.select(
        "*", seeded_hash(key, seed, kind).alias(_HASH), key.alias(_KEY), tie.alias(_TIE)
    )


def _edges(undecided: DataFrame, by: Sequence[str], level: Column) -> DataFrame:
    """Per class: the value of ``level`` at which its places run out, the rows that have this
    value and the places left for them.

    Values below the edge are taken whole. The edge is null if the class fits.
    """
    running = Window.partitionBy(*by).orderBy("__level")
    past = F.col("__upto") > F.col(_LEFT)
    return (
        undecided.groupBy(*by, _LEFT, level.alias("__level"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__upto",
            F.sum("__n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .groupBy(*by, _LEFT)
        .agg(
            F.min(F.when(past, F.struct("__level", "__n"))).alias("__first"),
            F.coalesce(F.max(F.when(~past, F.col("__upto"))), F.lit(0)).alias("__taken"),
        )
        .select(
            *by,
            F.col("__first.__level").alias("__edge"),
            F.col("__first.__n").alias("__rows"),
            (F.col(_LEFT) - F.col("__taken")).cast("bigint").alias(_LEFT),
        )
    )


def _by_window(keyed: DataFrame, columns: Sequence[str], by: Sequence[str], limit: Column):
    order = [_HASH, _KEY, _TIE, *_orderable(keyed, columns)]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return keyed.withColumn("__rank", rank).filter(F.col("__rank") <= limit).select(*columns)


def _by_cutoff(
    keyed: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    kind: str,
    quotas: DataFrame | None,
    cap: int | None,
) -> DataFrame:
    """The rows :func:`_by_window` keeps, without sorting a class.

    The order is narrowed down level by level: rows are counted per value of a coarse level, the
    value at which the places of a class run out is found, and only rows with that value go on
    to the next, finer level. Levels are growing prefixes of the key hash, then the key itself
    (one key may hold any share of the rows), then growing prefixes of the tie hash. Each count
    is combined inside the tasks, so little is shuffled. As soon as few rows share the edge of
    every class they are ranked. Rows that share even the last edge are counted by content.

    Rows below an edge are kept by a filter on the source; they are never moved.
    """
    by = list(by)
    narrowed = _narrowed(keyed, by, kind, quotas, cap)
    rest = None
    if narrowed.undecided is not None:
        if narrowed.few:
            rest = _by_window(narrowed.undecided, columns, by, F.col(_LEFT))
        else:
            rest = _copies(narrowed.undecided, columns, by)
    kept = null_safe_join(keyed, narrowed.edges, by).filter(narrowed.below()).select(*columns)
    return kept if rest is None else kept.unionByName(rest)


@dataclass
class _Narrowed:
    """Edges per class, from the coarsest level on, and the rows that share even the last one."""

    edges: DataFrame
    levels: list[tuple[Column, Column]]  # level and its edge
    undecided: DataFrame | None = None  # with the places left for their class
    few: bool = False
    open_classes: DataFrame | None = None  # the classes of ``undecided``

    def below(self) -> Column:
        """Whether a row comes before the edges of its class."""
        # a deeper edge is missing where no place was left above it
        below = F.lit(False)
        for level, edge in reversed(self.levels):
            below = F.coalesce(level < edge, F.lit(False)) | (F.coalesce(level == edge, F.lit(False)) & below)
        return F.col("__edge0").isNull() | below

    def on_edge(self) -> Column:
        """Whether a row lies on every edge that was found."""
        on = F.lit(True)
        for level, edge in self.levels:
            on = on & F.coalesce(level == edge, F.lit(False))
        return on


def _narrowed(
    keyed: DataFrame, by: list[str], kind: str, quotas: DataFrame | None, cap: int | None
) -> _Narrowed:
    """Find the edges of the rows that :func:`_by_cutoff` keeps."""
    levels = [
        *[hash_bucket(F.col(_HASH), bits, kind) for bits in PREFIX_BITS],
        F.struct(_HASH, _KEY),
        *[hash_bucket(F.col(_TIE), bits, kind) for bits in PREFIX_BITS],
    ]
    if quotas is None:
        undecided = keyed.withColumn(_LEFT, F.lit(cap).cast("bigint"))
    else:
        wanted = quotas.select(*by, F.col("quota").cast("bigint").alias(_LEFT))
        undecided = null_safe_join(keyed, side_table(wanted), by)

    found = None
    for depth, level in enumerate(levels):
        cut = side_table(_edges(undecided, by, level))
        edge = f"__edge{depth}"
        own = cut.select(*by, F.col("__edge").alias(edge))
        if found is None:
            found = _Narrowed(own, [])
        else:
            found.edges = null_safe_join(found.edges, own, by, "left")
        found.levels.append((level, F.col(edge)))
        narrow = cut.filter(F.col("__edge").isNotNull() & (F.col(_LEFT) > 0))
        most = narrow.agg(F.max("__rows")).first()[0]
        if most is None:
            return found
        undecided = (
            null_safe_join(undecided.drop(_LEFT), narrow, by)
            .filter(level == F.col("__edge"))
            .drop("__edge", "__rows")
        )
        if most <= EDGE_ROWS:
            found.few = True
            break
    found.undecided, found.open_classes = undecided, narrow.select(*by)
    return found


def _copies(
    rows: DataFrame, columns: Sequence[str], by: Sequence[str], others: bool = False
) -> DataFrame:
    """First ``__left`` rows per class of rows on one edge, or all the others, counted by content."""
    order = [_TIE, *_orderable(rows, columns)]
    running = Window.partitionBy(*by).orderBy(*order)
    return (
        rows.groupBy(*columns, _TIE, _LEFT)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__upto",
            F.sum("__n").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .withColumn("__take", F.expr("greatest(0, least(__n, __left - (__upto - __n)))"))
        .withColumn("__take", F.expr("__n - __take") if others else F.col("__take"))
        .filter("__take > 0")
        .withColumn("__chunk", F.expr(f"explode(sequence(0, (__take - 1) div {COPY_CHUNK}))"))
        .repartition(F.col("__chunk"))
        .withColumn("__take", F.expr(f"least({COPY_CHUNK}, __take - __chunk * {COPY_CHUNK})"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__take"))))
        .select(*columns)
    )


def class_cap(
    df: DataFrame,
    by: Sequence[str],
    key_cols: Sequence[str],
    cap: int,
    seed: int = SEED,
    *,
    kind: str = "xxhash64",
    fallback_cols: Sequence[str] | None = None,
    tie_cols: Sequence[str] | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """The ``cap`` rows of each class with the lowest key hash.

    ``strategy`` is ``window`` (a rank per class, which Spark limits inside each input partition
    for caps up to 1000; then one task per class ranks what the partitions leave), ``cutoff`` (see
    :func:`_by_cutoff`) or ``auto``. All give the same rows.
    """
    columns = df.columns
    keyed = _keyed(df, key_cols, fallback_cols, tie_cols, seed, kind)
    if strategy == "auto":
        few = cap <= WINDOW_CAP and cap * keyed.rdd.getNumPartitions() <= EDGE_ROWS
        strategy = "window" if few else "cutoff"
    if strategy == "window":
        return _by_window(keyed, columns, by, F.lit(cap))
    return _by_cutoff(keyed, columns, by, kind, None, cap)


def quotas(
    counts: DataFrame,
    reduction: float | Column,
    *,
    by: Sequence[str] = (),
    label: str = "label_tactic",
    n: str = "n",
    protected: Sequence[str] = PROTECTED_CLASSES,
) -> DataFrame:
    """Rows each class may keep so that the table shrinks by ``reduction``.

    Protected classes are kept whole. The rest of the target is shared out by class size,
    rounded down, and what rounding left over goes to the largest classes first, up to their
    size. ``counts`` has one row per class (and ``by`` group).
    """
    groups = list(by) or [F.lit(0)]
    all_of = Window.partitionBy(*groups)
    size_order = all_of.orderBy(F.desc("__free"), label)
    ahead = size_order.rowsBetween(Window.unboundedPreceding, -1)
    cut = F.lit(float(reduction)) if isinstance(reduction, (int, float)) else reduction
    shielded = F.col(label).isin(list(protected))
    out = counts.select(*by, label, F.col(n).cast("bigint").alias("n"), cut.alias("__cut"))
    out = (
        out.withColumn("__free", F.when(shielded, F.lit(0)).otherwise(F.col("n")).cast("bigint"))
        .withColumn("__total", F.sum("n").over(all_of))
        .withColumn("__free_total", F.sum("__free").over(all_of))
        .withColumn("__target", F.greatest(F.lit(1.0), F.rint(F.col("__total") * (1 - F.col("__cut")))))
        .withColumn(
            "__open",
            F.greatest(
                F.lit(0).cast("bigint"),
                F.col("__target").cast("bigint") - (F.col("__total") - F.col("__free_total")),
            ),
        )
        .withColumn(
            "__base",
            F.expr(
                "least(__free, CAST(__open AS DECIMAL(19,0)) * CAST(__free AS DECIMAL(19,0))"
                " div CAST(greatest(__free_total, 1) AS DECIMAL(19,0)))"
            ),
        )
        .withColumn("__rest", F.col("__open") - F.sum("__base").over(all_of))
        .withColumn("__room", F.col("__free") - F.col("__base"))
        .withColumn("__ahead", F.coalesce(F.sum("__room").over(ahead), F.lit(0)))
        .withColumn("__more", F.expr("greatest(0, least(__room, __rest - __ahead))"))
    )
    quota = (
        F.when((F.col("__cut") <= 0) | shielded, F.col("n"))
        .otherwise(F.col("__base") + F.col("__more"))
        .cast("bigint")
    )
    return out.select(*by, label, "n", quota.alias("quota"))


def quota_sample(
    df: DataFrame,
    quota_table: DataFrame,
    by: Sequence[str],
    key_cols: Sequence[str],
    seed: int = SEED,
    *,
    kind: str = "xxhash64",
    fallback_cols: Sequence[str] | None = None,
    tie_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Per class, the ``quota`` rows with the lowest key hash; classes without a quota go."""
    keyed = _keyed(df, key_cols, fallback_cols, tie_cols, seed, kind)
    return _by_cutoff(keyed, df.columns, by, kind, quota_table, None)


def sample_metadata(
    quota_table: DataFrame,
    reduction: float | Column,
    *,
    by: Sequence[str] = (),
    label: str = "label_tactic",
    protected: Sequence[str] = PROTECTED_CLASSES,
) -> DataFrame:
    """One row per group: what a quota sample was meant to keep."""
    cut = F.lit(float(reduction)) if isinstance(reduction, (int, float)) else reduction
    shielded = F.col(label).isin(list(protected))
    entry = F.struct(F.col(label).alias("key"), F.col("quota").alias("value"))
    return quota_table.groupBy(*by).agg(
        F.lit(POLICY_REDUCTION).alias("policy"),
        F.max(cut).alias("reported_reduction"),
        F.sum("n").alias("source_rows"),
        F.sum("quota").alias("target_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("target_class_counts"),
        F.coalesce(F.bool_and(F.when(shielded, F.col("quota") == F.col("n"))), F.lit(True)).alias(
            "protected_retained"
        ),
    )


def sample_for_run(
    df: DataFrame,
    *,
    dataset: str,
    stage: str,
    task: str,
    profile: str,
    method: str,
    cap: int,
    key_cols: Sequence[str],
    seed: int = SEED,
    label: str = "label_tactic",
    reduction: dict[tuple[str, str], float] | None = None,
    reduced_dataset: str = DATASET_2022,
    **key_options,
) -> tuple[DataFrame, dict]:
    """Sample a task the way the profile and method ask for, with the policy that was used."""
    policy = sample_policy(
        dataset=dataset,
        stage=stage,
        task=task,
        profile=profile,
        method=method,
        cap=cap,
        reduction=reduction,
        reduced_dataset=reduced_dataset,
    )
    if "cap_per_class" in policy:
        return class_cap(df, [label], key_cols, cap, seed, **key_options), policy
    cut = policy.get("reported_reduction", 0.0)
    if cut <= 0:
        return df, policy
    table = side_table(quotas(class_counts(df, [label]), cut, label=label))
    info = sample_metadata(table, cut, label=label).drop("policy", "reported_reduction").first()
    sampled = quota_sample(df, table, [label], key_cols, seed, **key_options)
    return sampled, {**policy, **info.asDict()}


def sample_policy(
    *,
    dataset: str,
    stage: str,
    task: str,
    profile: str,
    method: str,
    cap: int,
    reduction: dict[tuple[str, str], float] | None = None,
    reduced_dataset: str = DATASET_2022,
) -> dict:
    """How a task is sampled; equal policies give equal samples of a task."""
    if profile == "development":
        return {"policy": POLICY_CAP, "cap_per_class": cap}
    if method == "paper-compatible" and dataset == reduced_dataset:
        cut = (reduction or REDUCTION)[stage, task]
        return {"policy": POLICY_REDUCTION, "reported_reduction": cut}
    return {"policy": POLICY_FULL}


def split_column(
    key: Column, seed: int = SEED, train_fraction: float = TRAIN_FRACTION, kind: str = "xxhash64"
) -> Column:
    """``train`` or ``test`` by hash of the key: rows that share a key share a side."""
    bucket = F.pmod(seeded_hash(key, seed, kind), F.lit(10_000))
    return F.when(bucket < int(train_fraction * 10_000), F.lit("train")).otherwise(F.lit("test"))


def hash_split(
    df: DataFrame,
    key_cols: Sequence[str],
    seed: int = SEED,
    train_fraction: float = TRAIN_FRACTION,
    *,
    kind: str = "xxhash64",
    fallback_cols: Sequence[str] | None = None,
    per_class: Sequence[str] = (),
    tie_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split``; both sides come from one scan. The share is approximate per class, unless ``per_class``
    names the columns of the class (see :func:`stratified_split`)."""
    if per_class:
        return stratified_split(
            df, per_class, key_cols, seed, train_fraction, kind=kind, fallback_cols=fallback_cols, tie_cols=tie_cols
        )
    key = stable_key(key_cols, fallback_cols)
    return df.withColumn("split", split_column(key, seed, train_fraction, kind))


def stratified_split(
    df: DataFrame,
    by: Sequence[str],
    key_cols: Sequence[str],
    seed: int = SEED,
    train_fraction: float = TRAIN_FRACTION,
    *,
    kind: str = "xxhash64",
    fallback_cols: Sequence[str] | None = None,
    tie_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``split`` so that the train side has the exact share of every class, rounded down: its rows with the
    lowest key hashes.

    The hash up to which a class goes to the train side is found by counts, as in :func:`class_cap`; rows
    before and behind it get their side where they are, and only those on the edge are ranked. Of rows
    with the key on the edge of a class, some may go to either side. A null class is a class.
    """
    columns, by = df.columns, list(by)
    keyed = _keyed(df, key_cols, fallback_cols, tie_cols, seed, kind)
    # in millionths, since 0.7 of 90 rows is less than 63 as a double
    millionths = round(train_fraction * 1_000_000)
    shares = df.groupBy(*by).agg(F.expr(f"count(1) * {millionths} div 1000000").alias("quota"))
    narrowed = _narrowed(keyed, by, kind, shares, None)
    rows = null_safe_join(keyed, narrowed.edges, by)
    sided = F.when(narrowed.below(), F.lit("train")).otherwise(F.lit("test")).alias("split")
    if narrowed.undecided is None:
        return rows.select(*columns, sided)
    still = narrowed.open_classes.withColumn("__open", F.lit(True))
    rows = null_safe_join(rows, still, by, "left")
    decided = rows.filter(~(narrowed.on_edge() & F.col("__open").isNotNull())).select(*columns, sided)
    if narrowed.few:
        order = [_HASH, _KEY, _TIE, *_orderable(keyed, columns)]
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        sided = F.when(F.col("__rank") <= F.col(_LEFT), F.lit("train")).otherwise(F.lit("test")).alias("split")
        return decided.unionByName(narrowed.undecided.withColumn("__rank", rank).select(*columns, sided))
    for side, others in (("train", False), ("test", True)):
        edge = _copies(narrowed.undecided, columns, by, others)
        decided = decided.unionByName(edge.withColumn("split", F.lit(side)))
    return decided


def content_split(
    df: DataFrame,
    seed: int = SEED,
    train_fraction: float = TRAIN_FRACTION,
    *,
    kind: str = "xxhash64",
) -> DataFrame:
    """Add ``split``: a seeded draw for every row that depends on its content only, not on files or partitions.

    Equal rows are counted, so that a row held by a third of the table is one row here, and numbered among
    themselves; the draw is a hash of content and number. Copies are dealt out again in bounded chunks.
    """
    columns = df.columns
    nested = [c for c in columns if c not in _orderable(df, columns)]
    if nested:
        raise ValueError(f"rows cannot be compared by the columns {nested}")
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    chunks = (
        counted.withColumn("__chunk", F.expr(f"explode(sequence(0, (__n - 1) div {COPY_CHUNK}))"))
        .repartition(*columns, "__chunk")
        .withColumn("__copy", F.expr(
            f"explode(sequence(__chunk * {COPY_CHUNK} + 1, least(__n, (__chunk + 1) * {COPY_CHUNK})))"
        ))
    )
    if kind == "xxhash64":
        draw = F.xxhash64(*columns, "__copy", F.lit(seed))
    else:
        # a null differs from an empty text
        parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (*columns, "__copy")]
        draw = seeded_hash(F.concat_ws("|", *parts), seed, kind)
    train = F.pmod(draw, F.lit(10_000)) < int(train_fraction * 10_000)
    return chunks.select(*columns, F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("split"))


def random_split(df: DataFrame, seed: int = SEED, train_fraction: float = TRAIN_FRACTION):
    """Seeded random split; the rows of a side depend on how ``df`` is partitioned."""
    return tuple(df.randomSplit([train_fraction, 1 - train_fraction], seed=seed))


def split_for_run(
    df: DataFrame,
    *,
    dataset: str,
    task: str,
    method: str,
    key_cols: Sequence[str],
    seed: int = SEED,
    hashed: tuple[str, str] = (DATASET_2022, "Reconnaissance"),
    **key_options,
) -> DataFrame:
    """Add ``split``: by hash, or at random where the published method drew at random."""
    if method == "corrected" or (dataset, task) == hashed:
        return hash_split(df, key_cols, seed, **key_options)
    train, test = random_split(df, seed)
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )


def class_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per class, task, split or whatever ``by`` names, in one job."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Append tables by column name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
