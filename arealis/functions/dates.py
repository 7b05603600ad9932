"""Dates: parsing, ranges, intervals and time buckets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

# Bucket granularities of whole days, and shorter ones with their seconds.
CALENDAR = ("day", "week", "month", "quarter", "year")
CLOCK = {
    "second": 1,
    "minute": 60,
    "five_minute": 300,
    "ten_minute": 600,
    "fifteen_minute": 900,
    "thirty_minute": 1800,
    "hour": 3600,
}
GRANULARITIES = ("all", "none", *CLOCK, *CALENDAR)


def parse_date(column: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss.SSS z") -> Column:
    """Parse a zoned date text and keep the date in the session time zone."""
    return F.to_timestamp(column, pattern).cast("date")


def typed(df: DataFrame, column: str, value: Any) -> Column:
    """``value`` as a literal of the column's own type.

    Comparing a column with a literal of another type wraps the column in a
    cast, and a cast column is not pushed to the files.
    """
    return F.lit(value).cast(df.schema[column].dataType)


def _as_date(value: dt.date | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value[:10])


def day_bounds(df: DataFrame, column: str, start: dt.date | str, end: dt.date | str) -> Column:
    """Days from ``start`` to ``end``, both whole days included.

    A timestamp column is compared with the first instant after ``end``, which
    keeps rows later on the last day and leaves the column bare for pushdown.
    """
    first, last = _as_date(start), _as_date(end)
    kind = df.schema[column].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        after = last + dt.timedelta(days=1)
        return (F.col(column) >= typed(df, column, first.isoformat())) & (
            F.col(column) < typed(df, column, after.isoformat())
        )
    day = F.col(column) if isinstance(kind, DateType) else F.to_date(column)
    return day.between(F.lit(first), F.lit(last))


def in_intervals(df: DataFrame, column: str, intervals: Sequence[tuple[Any, Any]]) -> Column:
    """Inside any of the half-open intervals ``[start, end)``."""
    if not intervals:
        raise ValueError("at least one interval is needed")

    def bound(value: Any) -> Column:
        return typed(df, column, value.isoformat() if isinstance(value, dt.date) else value)

    return reduce(
        lambda a, b: a | b,
        [(F.col(column) >= bound(start)) & (F.col(column) < bound(end)) for start, end in intervals],
    )


def bucket_start(df: DataFrame, column: str, granularity: str) -> Column:
    """First instant of the bucket that holds the column's value.

    A ``date`` for day and longer buckets, the column's kind of timestamp for
    shorter ones.
    ``all`` puts every row into one bucket, ``none`` keeps the instant itself.
    """
    return bucket_start_of(df.schema[column].dataType, F.col(column), granularity)


def bucket_start_of(kind: DataType, moment: Column, granularity: str) -> Column:
    """:func:`bucket_start` of any column expression of the given type."""
    grain = granularity.lower()
    if grain not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}, expected one of {GRANULARITIES}")
    if isinstance(kind, StringType):
        moment = F.to_timestamp(moment)
    if grain == "all":
        return F.lit(dt.date(1970, 1, 1))
    if grain == "day":
        return moment.cast("date")
    if grain in CALENDAR:
        return F.trunc(moment.cast("date"), grain)
    if grain == "none":
        return moment
    seconds = CLOCK.get(grain)
    if isinstance(kind, TimestampNTZType):
        # wall-clock arithmetic, free of any time zone
        of_day = F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)
        since_midnight = F.make_dt_interval(secs=of_day - F.pmod(of_day, F.lit(seconds)))
        return moment.cast("date").cast("timestamp_ntz") + since_midnight
    moment = moment.cast("timestamp")
    if grain in ("second", "minute", "hour"):
        return F.date_trunc(grain, moment)
    instant = F.unix_seconds(moment)
    return F.timestamp_seconds(instant - F.pmod(instant, F.lit(seconds)))


def bucket_series(df: DataFrame, column: str, granularity: str, intervals: Sequence[tuple[Any, Any]]) -> Column:
    """The starts of all buckets that the half-open intervals touch, as an ascending array of a constant length."""
    grain = granularity.lower()
    text = isinstance(df.schema[column].dataType, StringType)
    parts = []
    for start, end in intervals:
        bounds = [typed(df, column, v.isoformat() if isinstance(v, dt.date) else v) for v in (start, end)]
        ends = df.select(bounds[0].alias("start"), bounds[1].alias("end"))
        # the same rules as for a column of the frame, on constants
        first = bucket_start_of(ends.schema["start"].dataType, bounds[0], grain)
        last = F.to_timestamp(bounds[1]) if text else bounds[1]
        if grain == "all":
            parts.append(F.array(first))
            continue
        if grain == "day" or grain in CALENDAR:
            step = F.expr(f"interval {'1 day' if grain == 'day' else '3 month' if grain == 'quarter' else '1 ' + grain}")
            series = F.sequence(first, F.greatest(first, last.cast("date")), step)
        else:
            step = F.expr(f"interval {CLOCK[grain]} second")
            kind = "timestamp_ntz" if isinstance(df.schema[column].dataType, TimestampNTZType) else "timestamp"
            series = F.sequence(first, F.greatest(first, last.cast(kind)), step)
        parts.append(F.filter(series, lambda b: b < last))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))
