"""Ranges of a column's values, numbered so that they can be accumulated in parallel."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    NumericType,
    TimestampNTZType,
    TimestampType,
)

BLOCK = "_block"

# Cuts at which values are divided; the spans between them are divided further.
MAX_CUTS = 255


def order_number(df: DataFrame, column: str) -> Column | None:
    """A number that grows with the column's value, or None if it has none."""
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return F.col(column).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, TimestampNTZType):
        # from its parts: a detour over an instant would depend on the time zone
        minutes = (F.unix_date(F.col(column).cast("date")) * 24 + F.hour(column)) * 60 + F.minute(column)
        return minutes * 60.0 + F.date_part(F.lit("SECOND"), column).cast("double")
    if kind.typeName() == "string":
        # the first six bytes, left-aligned, as one number below 2**48
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return None


def with_ranges(df: DataFrame, order: str, cuts: Sequence[float], parts: int = 1) -> DataFrame:
    """Add the block number, taking all rows as one large key."""
    if not 0 < len(cuts) <= MAX_CUTS:
        raise ValueError(f"between 1 and {MAX_CUTS} cuts are needed")
    steps = len(cuts).bit_length()
    padded = F.lit(_padded(cuts, steps)).cast(ArrayType(DoubleType(), False))
    return _number_blocks(df.withColumns({"_cuts": padded, "_parts": F.lit(parts)}), order, steps)


def _padded(cuts: Sequence[float], steps: int) -> list[float]:
    return [float(c) for c in cuts] + [math.inf] * (2**steps - 1 - len(cuts))


def _number_blocks(rows: DataFrame, order: str, steps: int) -> DataFrame:
    """Replace the columns ``_cuts`` and ``_parts`` by the block number."""
    rows = rows.withColumns({"_place": order_number(rows, order), "_span": F.lit(0)})
    # binary search for the number of cuts at or below the value
    cuts, parts, place, span = F.col("_cuts"), F.col("_parts"), F.col("_place"), F.col("_span")
    for step in (2**i for i in reversed(range(steps))):
        rows = rows.withColumn("_span", span + (F.get(cuts, span + (step - 1)) <= place).cast("int") * step)
    low, high = F.get(cuts, span - 1), F.get(cuts, span)
    inner = (span > 0) & (high < F.lit(math.inf)) & (parts > 1)
    part = F.when(inner, F.width_bucket(place, low, high, parts) - 1).otherwise(F.lit(0))
    within = F.coalesce(F.least(part, parts - 1), F.lit(0)).cast("int")
    # a missing order value sorts first, so it belongs to the first block
    block = F.when(cuts.isNotNull(), F.coalesce(span * parts + within, F.lit(0)))
    return rows.withColumn(BLOCK, block).drop("_cuts", "_parts", "_place", "_span")
