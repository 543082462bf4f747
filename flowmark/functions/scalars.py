"""Scalar expressions of the feature, metric and comparison operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmark.fixed_values import GRADES, MISSING_TOKEN, WORST_GRADE


def text_value(column: Column, mark_blank: bool) -> Column:
    """Null becomes the empty text; blank text becomes the missing token if asked for."""
    text = F.coalesce(column, F.lit(""))
    if not mark_blank:
        return text
    return F.when(F.trim(text) == "", F.lit(MISSING_TOKEN)).otherwise(text)


def number_value(column: Column, data_type: T.DataType) -> Column | None:
    """Double form of a numeric, boolean or timestamp column; ``None`` for other types.

    A timestamp without zone becomes the epoch seconds it would have in UTC, whatever the zone
    of the session.
    """
    if isinstance(data_type, T.TimestampNTZType):
        minutes = F.unix_date(column.cast("date")) * F.lit(1440).cast("bigint")
        minutes = minutes + F.hour(column) * 60 + F.minute(column)
        micros = (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")
        return (minutes * 60_000_000 + micros) / F.lit(1e6)
    if isinstance(data_type, (T.TimestampType, T.NumericType, T.BooleanType)):
        return column.cast("double")
    return None


def observed(column: Column) -> Column:
    """The value with NaN turned into null, so that aggregates skip both."""
    return F.nanvl(column, F.lit(None).cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0.0 where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def grade(percentage_points: Column) -> Column:
    """Accuracy grade of an absolute error in percentage points; bounds are inclusive."""
    chain = None
    for bound, name in GRADES:
        test = percentage_points <= F.lit(bound)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit(WORST_GRADE))


def vector_width(df: DataFrame, column: str) -> int:
    """Vector width from the column's ML attributes, or from one row where they are missing."""
    group = df.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in group:
        return int(group["num_attrs"])
    attributes = group.get("attrs")
    if attributes:
        return sum(len(items) for items in attributes.values())
    row = df.select(column).first()
    if row is None:
        raise ValueError("cannot tell the feature width of an empty table")
    return int(row[0].size)
