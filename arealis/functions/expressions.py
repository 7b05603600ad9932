"""Scalar and array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(column: Column | str) -> Column:
    """Text of a key without double quotes."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.replace(text, F.lit('"'), F.lit(""))


def int_range(end: Column | int) -> Column:
    """``0 .. end-1`` as an array; empty when ``end`` is not positive."""
    end = F.lit(end) if isinstance(end, int) else end
    stop = end.cast("int")
    # sequence(0, -1) would count downward
    return F.when(stop <= 0, F.expr("cast(array() as array<int>)")).otherwise(
        F.sequence(F.lit(0), F.greatest(stop - 1, F.lit(0)))
    )


def slice_from(array: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` elements from the 0-based position ``start``."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.slice(array, start + 1, length)


def window_means(values: Column, size: int) -> Column:
    """Mean of every full window of ``size`` consecutive elements; nulls are ignored.

    For arrays already at hand.  A series held as rows belongs in
    :func:`arealis.operators.windows.moving_average`.
    """
    if size < 1:
        raise ValueError("size must be at least 1")

    def mean(start: Column) -> Column:
        present = F.filter(slice_from(values, start, size), lambda v: v.isNotNull())
        total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
        return F.when(F.size(present) > 0, total / F.size(present))

    return F.transform(int_range(F.size(values) - (size - 1)), mean)
