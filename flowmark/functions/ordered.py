"""Orders over whole tables, kept distributed.

A global ``row_number`` or running sum would sort a table in one task. Here the rows are range
partitioned once; every range keeps its own order and only one total per range is summed up
over the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmark.functions.durable import durable, null_safe_join, side_table
from flowmark.functions.scalars import observed

PART = "__part"
#: Accuracy of quantile sketches: ranks are off by at most one in this many rows.
SKETCH = 10_000


def by_range(df: DataFrame, *order: Column | str) -> DataFrame:
    """Range partition ``df`` and number the ranges in :data:`PART`."""
    return df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id())


def global_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number the rows of ``df`` from 0 in ``order`` (which has to be total)."""
    placed = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    # The id holds the number of the partition above 33 bits of row position.
    placed = placed.select(
        *df.columns,
        F.shiftright("__id", 33).alias(PART),
        F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"),
    )
    sizes = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("__size"))
    ahead = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = side_table(
        sizes.select(PART, F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__offset"))
    )
    return placed.join(offsets, PART).select(
        *df.columns, (F.col("__offset") + F.col("__pos")).alias(name)
    )


def exact_medians(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact median of each column per group; null groups are kept, null and NaN values skipped.

    One pass sketches the quantiles next to the middle, with the sketches merged inside the
    tasks. A second pass only tells values below that bracket from those inside it, and counts
    them, so about six in ``SKETCH`` distinct values of a group are shuffled however large the
    group is. These are spread over ranges, and the ranges that hold the middle are ordered.
    """
    by, columns = list(by), list(columns)
    keys = [*by, "__metric"]
    values = {c: observed(F.col(c).cast("double")) for c in columns}
    directly = df.groupBy(*by).agg(*[F.median(v).alias(c) for c, v in values.items()])
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) <= SKETCH:
        return directly
    around = [0.5 - 3 / SKETCH, 0.5 + 3 / SKETCH]
    sketched = df.groupBy(*by).agg(
        *[F.count(v).alias(f"__n_{c}") for c, v in values.items()],
        *[F.percentile_approx(v, around, SKETCH).alias(f"__b_{c}") for c, v in values.items()],
    )
    everything = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    bounds = side_table(
        sketched.select(
            *by,
            *[f"__n_{c}" for c in columns],
            *[  # small groups are taken whole
                F.when(F.col(f"__n_{c}") > SKETCH, F.col(f"__b_{c}")).otherwise(everything).alias(
                    f"__b_{c}"
                )
                for c in columns
            ],
        )
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("__metric"),
                F.col(f"__n_{c}").alias("__total"),
                # what lies below the bracket only has to be counted
                F.when(v >= F.col(f"__b_{c}")[0], v).otherwise(float("-inf")).alias("__value"),
                (v <= F.col(f"__b_{c}")[1]).alias("__wanted"),
            )
            for c, v in values.items()
        ]
    )
    counted = (
        null_safe_join(df, bounds, by)
        .select(*by, F.explode(entries).alias("__e"))
        .select(*by, "__e.*")
        .filter("__wanted")
        .groupBy(*keys, "__total", "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranged = durable(by_range(counted, *keys, "__value"))
    ahead = (
        Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = (
        ranged.groupBy(*keys, "__total", PART)
        .agg(F.sum("__n").alias("__size"))
        .withColumn("__offset", F.coalesce(F.sum("__size").over(ahead), F.lit(0)))
        # 0-based positions of the two middle values (the same one for an odd total)
        .withColumn("__lo", F.expr("(__total - 1) div 2"))
        .withColumn("__hi", F.expr("__total div 2"))
        .filter("__offset <= __hi AND __lo < __offset + __size")
        .select(*keys, PART, "__offset", "__lo", "__hi")
    )
    inside = Window.partitionBy(*keys, PART).orderBy("__value")
    middle = (
        null_safe_join(ranged, side_table(parts), [*keys, PART])
        .withColumn(
            "__upto",
            F.col("__offset")
            + F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .withColumn("__from", F.col("__upto") - F.col("__n"))
        .groupBy(*keys)
        .agg(
            F.max(F.expr("CASE WHEN __from <= __lo AND __lo < __upto THEN __value END")).alias("l"),
            F.max(F.expr("CASE WHEN __from <= __hi AND __hi < __upto THEN __value END")).alias("h"),
        )
    )
    medians = middle.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("__metric") == c, (F.col("l") + F.col("h")) / 2)).alias(c)
            for c in columns
        ]
    )
    # a group whose values are all missing still has its row
    found = null_safe_join(bounds.select(*by, *[f"__n_{c}" for c in columns]), medians, by, "left")
    found = durable(found)
    # a sketch may leave the middle outside of its bracket: then the group is ordered as a whole
    missed = F.lit(False)
    for c in columns:
        gone = F.col(c).isNull() | (F.col(c) == float("-inf"))
        missed = missed | ((F.col(f"__n_{c}") > 0) & gone)
    again = found.filter(missed).select(*by)
    found = found.drop(*[f"__n_{c}" for c in columns])
    if again.isEmpty():
        return found
    counted = found.columns
    wrong = null_safe_join(df, again, by)
    right = wrong.groupBy(*by).agg(*[F.median(v).alias(c) for c, v in values.items()])
    marked = null_safe_join(found, again.withColumn("__again", F.lit(True)), by, "left")
    kept = marked.filter(F.col("__again").isNull()).select(*counted)
    return kept.unionByName(right.select(*counted))
