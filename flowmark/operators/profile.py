"""Statistics of categorical columns: indices, unseen values, hash load."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.fixed_values import HASH_BUCKETS
from flowmark.functions.durable import BROADCAST_BYTES, durable, side_table
from flowmark.functions.ordered import global_index

#: Most frequent values per column that are joined by broadcast.
HEAD_VALUES = 10_000


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per ``(column, value)`` of several text columns in one job.

    The counts are combined before the shuffle, so a frequent value costs one row per task.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    )
    return (
        df.select(pairs.alias("__p"))
        .select("__p.*")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Index of every value: most frequent first, ties in alphabetical order, from 0 per column.

    Works for any number of distinct values; nothing is collected.
    """
    order = [F.col("column"), F.desc("n"), F.col("value")]
    placed = global_index(value_counts(df, columns), order, "__place")
    first = side_table(placed.groupBy("column").agg(F.min("__place").alias("__first")))
    return placed.join(first, "column").select(
        "column", "value", "n", (F.col("__place") - F.col("__first")).alias("index")
    )


@dataclass(frozen=True)
class Lookup:
    """Index of one column, measured once: how many values it has and how many go by broadcast."""

    table: DataFrame  # value, index
    known: int
    head: int


def lookup(index: DataFrame, column: str, head: int = HEAD_VALUES) -> Lookup:
    """The part of :func:`category_index` that belongs to ``column``, ready to be applied."""
    own = index.filter(F.col("column") == column).select("value", "index")
    size = F.sum(F.when(F.col("index") < head, F.octet_length("value")))
    known, size = own.agg(F.count(F.lit(1)), size).first()
    # long texts: everything goes through the shuffle join
    return Lookup(own, known, head if (size or 0) <= BROADCAST_BYTES else 0)


def index_column(df: DataFrame, column: str, own: Lookup, output: str) -> DataFrame:
    """Replace values by their index as a double; unseen values get the number of known ones.

    The most frequent values are looked up by broadcast, the others by a join on the value. Rows that
    were found (or are null) take part in that join under a hash of their columns that matches nothing and
    spreads them, so the input is read once however many columns are indexed one after the other,
    and no value in the join can hold more than one part in ``head`` of the rows.
    """
    table = own.table.select(F.col("value").alias("__value"), F.col("index").alias("__index"))
    out = df.withColumn("__index", F.lit(None).cast("bigint"))
    if own.head:
        top = F.broadcast(table.filter(F.col("__index") < own.head))
        out = df.join(top, df[column] == top["__value"], "left").drop("__value")
    if own.known > own.head:
        missed = F.col("__index").isNull() & F.col(column).isNotNull()
        # by content, so that a task that runs again deals its rows out as before; Spark splits a key of equal rows
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType, T.UserDefinedType))]
        spread = F.concat(F.lit("-"), F.xxhash64(*plain).cast("string"))
        rare = table.filter(F.col("__index") >= own.head).select(
            F.concat(F.lit("="), "__value").alias("__other"), F.col("__index").alias("__rare")
        )
        out = (
            out.withColumn("__key", F.when(missed, F.concat(F.lit("="), F.col(column))).otherwise(spread))
            .join(rare, F.col("__key") == F.col("__other"), "left")
            .withColumn("__index", F.coalesce("__index", "__rare"))
            .drop("__key", "__other", "__rare")
        )
    return out.withColumn(output, F.coalesce("__index", F.lit(own.known)).cast("double")).drop("__index")


def unseen_categories(fit: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``other`` whose value does not occur in ``fit``, per column, zeros included.

    All columns go through one anti join of counted values against distinct values.
    """
    counted = value_counts(other, columns)
    known = value_counts(fit, columns).select("column", "value")
    strange = counted.join(known, ["column", "value"], "left_anti")
    nothing = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    zeros = other.sparkSession.range(1).select(nothing, F.lit(0).cast("bigint").alias("n"))
    return (
        strange.select("column", "n")
        .unionByName(zeros)
        .groupBy("column")
        .agg(F.sum("n").alias("rows"))
    )


#: Bits of a membership filter for each value, bits set by a value, and the largest filter in words of 64 bits.
FILTER_BITS, FILTER_MARKS, FILTER_WORDS = 12, 3, 1 << 20


def _filter_place(column: Column, value: Column, words: int) -> tuple[Column, Column]:
    """The word of a value in a membership filter, and the bits it sets there."""
    place = F.pmod(F.xxhash64(F.lit(0), column, value), F.lit(words))
    bits = F.lit(0).cast("bigint")
    for i in range(1, FILTER_MARKS + 1):
        at = F.pmod(F.xxhash64(F.lit(i), column, value), F.lit(64)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return place, bits


def membership_filter(values: DataFrame, words: int) -> DataFrame:
    """A Bloom filter of ``(column, value)`` rows: ``place`` and its 64 ``bits``, put together by the tasks."""
    place, bits = _filter_place(F.col("column"), F.col("value"), words)
    return values.groupBy(place.alias("place")).agg(F.bit_or(bits).alias("bits"))


def unseen_by_filter(fit: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`unseen_categories` by way of a membership filter.

    Rows of ``other`` that a filter of the values of ``fit`` does not know are unseen for sure, and counted where they
    are. Only the rest is counted by value and confirmed by a join, so the more rows are unseen, the less is moved.
    The filter is broadcast; values too many for ``FILTER_WORDS`` share words, which costs false alarms, not results.
    """
    known = durable(value_counts(fit, columns).select("column", "value").filter(F.col("value").isNotNull()))
    words = max(1, min(FILTER_WORDS, -(-known.count() * FILTER_BITS // 64)))
    table = membership_filter(known, words).select("place", "bits")  # at most FILTER_WORDS rows of two numbers
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    rows = other.select(pairs.alias("__p")).select("__p.*")
    place, bits = _filter_place(F.col("column"), F.col("value"), words)
    looked = rows.withColumns({"place": place, "__own": bits}).join(F.broadcast(table), "place", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("__own")) == F.col("__own"), F.lit(False)) & F.col("value").isNotNull()
    # one row per column for what is unseen for sure, one per value for the rest
    counted = looked.groupBy("column", maybe.alias("maybe"), F.when(maybe, F.col("value")).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counted = durable(counted)
    strange = counted.filter("maybe").join(known, ["column", "value"], "left_anti")
    zeros = fit.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"), F.lit(0).cast("bigint").alias("n"))
    sure = counted.filter("NOT maybe").select("column", "n")
    return sure.unionByName(strange.select("column", "n")).unionByName(zeros).groupBy("column").agg(F.sum("n").alias("rows"))


def hash_load(df: DataFrame, columns: Sequence[str], buckets: int = HASH_BUCKETS) -> DataFrame:
    """Distinct values per hashed column and how full the shared buckets are."""
    counted = value_counts(df, columns).groupBy("column").agg(F.count("value").alias("d"))
    entry = F.struct(F.col("column").alias("key"), F.col("d").alias("value"))
    return (
        counted.agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("distinct_values"),
            F.coalesce(F.sum("d"), F.lit(0)).alias("total_distinct"),
        )
        .withColumn("buckets", F.lit(buckets))
        .withColumn(
            "minimum_collisions",
            F.greatest(F.lit(0).cast("bigint"), F.col("total_distinct") - buckets),
        )
        .withColumn("load_factor", F.col("total_distinct") / F.lit(float(buckets)))
    )


_MASK = (1 << 32) - 1


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _times(a: Column, factor: int) -> Column:
    """Product of two 32-bit numbers modulo 2**32; the parts stay within 64 bits."""

    def product(x: Column) -> Column:
        high = (x * F.lit(factor >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16)
        return (x * F.lit(factor & 0xFFFF) + high).bitwiseAND(F.lit(_MASK))

    return _bound(a, product)


def _turned(a: Column, bits: int) -> Column:
    """``a`` rotated to the left in 32 bits."""
    return _bound(
        a, lambda x: F.shiftleft(x, bits).bitwiseAND(F.lit(_MASK)).bitwiseOR(F.shiftright(x, 32 - bits))
    )


def _folded(a: Column, bits: int) -> Column:
    """``a`` with its upper bits laid over the lower."""
    return _bound(a, lambda x: x.bitwiseXOR(F.shiftright(x, bits)))


def hashed_slot(text: Column, buckets: int = HASH_BUCKETS) -> Column:
    """The slot in which Spark's ``FeatureHasher`` counts the text ``column=value``: Murmur3 of its UTF-8 bytes with
    seed 42, as a signed number, modulo ``buckets``.

    The built-in ``hash`` treats the last bytes otherwise, so it cannot stand in for it.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    length = F.octet_length(text)

    def word(i: Column) -> Column:
        # four bytes from the lowest, zeros behind the last
        own = F.rpad(F.substring(digits, i * 8 + 1, F.lit(8)), 8, "0")
        turned = F.concat(*[F.substring(own, at, 2) for at in (7, 5, 3, 1)])
        return F.conv(turned, 16, 10).cast("bigint")

    def mixed(k: Column) -> Column:
        return _times(_turned(_times(k, 0xCC9E2D51), 15), 0x1B873593)

    def hashed(words: Column) -> Column:
        whole = F.slice(words, 1, F.floor(length / F.lit(4)).cast("int"))
        state = F.aggregate(
            whole,
            F.lit(42).cast("bigint"),
            lambda h, k: (_times(_turned(h.bitwiseXOR(mixed(k)), 13), 5) + F.lit(0xE6546B64)).bitwiseAND(F.lit(_MASK)),
        )
        # the last word, if it is short; without one it counts as zero
        state = state.bitwiseXOR(F.when(length % 4 > 0, mixed(F.element_at(words, -1))).otherwise(F.lit(0)))
        state = _times(_folded(state.bitwiseXOR(length.cast("bigint")), 16), 0x85EBCA6B)
        state = _folded(_times(_folded(state, 13), 0xC2B2AE35), 16)
        return _bound(state, lambda x: F.when(x >= 1 << 31, x - F.lit(1 << 32)).otherwise(x))

    count = F.ceil(length / F.lit(4)).cast("int")
    places = F.when(length > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.pmod(_bound(F.transform(places, word), hashed), F.lit(buckets)).cast("int")


def hash_collisions(
    df: DataFrame, columns: Sequence[str], buckets: int = HASH_BUCKETS, prefix: str = ""
) -> DataFrame:
    """Every value of the hashed columns that shares its slot with another: ``slot``, ``column``, ``value``, its
    ``rows``, and the ``slot_values`` and ``slot_rows`` of the slot. Null values are not hashed.

    ``prefix`` stands before the names of the columns in the hasher. Values are counted first, so a slot is worked out
    once for each; what is brought together is one row per slot and its size, not the values of a slot.
    """
    counted = value_counts(df, columns).filter(F.col("value").isNotNull())
    slotted = counted.select(
        hashed_slot(F.concat(F.lit(prefix), "column", F.lit("="), "value"), buckets).alias("slot"),
        "column",
        "value",
        F.col("n").alias("rows"),
    )
    full = slotted.groupBy("slot").agg(
        F.count(F.lit(1)).alias("slot_values"), F.sum("rows").alias("slot_rows")
    ).filter("slot_values > 1")
    return slotted.join(side_table(full), "slot").select(
        "slot", "column", "value", "rows", "slot_values", "slot_rows"
    )
