"""Aggregates over date ranges and time buckets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealis.functions.dates import bucket_series, bucket_start, day_bounds, in_intervals
from arealis.functions.predicates import predicate


def date_range(df: DataFrame, column: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both days included."""
    return df.where(day_bounds(df, column, start, end))


def range_average(
    df: DataFrame,
    key: str,
    key_value: Any,
    date: str,
    start: dt.date | str,
    end: dt.date | str,
    feature: str,
    *,
    out: str = "avg",
) -> DataFrame:
    """Average of a feature for one key over a range of days: one row, null if nothing matches."""
    rows = df.where(predicate({key: key_value}, df.schema)).where(day_bounds(df, date, start, end))
    return rows.agg(F.avg(feature).alias(out))


def time_bucket_agg(
    df: DataFrame,
    ts: str,
    granularity: str,
    *,
    aggs: Mapping[str, Column],
    intervals: Sequence[tuple[Any, Any]] | None = None,
    where: Mapping[str, Any] | Column | None = None,
    dims: Sequence[str] = (),
    out: str = "bucket",
) -> DataFrame:
    """Group rows by time bucket and dimensions.

    ``intervals`` are half-open and OR-ed, ``where`` is a filter on the rows;
    both reach the files.  The aggregates are combined on the map side, so one
    bucket with most of the rows is no hot spot.
    """
    rows = df
    if intervals is not None:
        rows = rows.where(in_intervals(df, ts, intervals))
    if where is not None:
        rows = rows.where(where if isinstance(where, Column) else predicate(where, df.schema))
    return rows.groupBy(bucket_start(df, ts, granularity).alias(out), *dims).agg(
        *[column.alias(name) for name, column in aggs.items()]
    )


def time_bucket_filled(
    df: DataFrame,
    ts: str,
    granularity: str,
    *,
    aggs: Mapping[str, Column],
    intervals: Sequence[tuple[Any, Any]],
    empty: Mapping[str, Any] | None = None,
    where: Mapping[str, Any] | Column | None = None,
    dims: Sequence[str] = (),
    out: str = "bucket",
) -> DataFrame:
    """:func:`time_bucket_agg` with a row for every bucket of the intervals, whether it has data or not.

    With ``dims`` that holds for each combination of their values that occurs.
    A bucket counts as soon as it begins before an interval's end and reaches
    into it.  ``empty`` gives the value of an aggregate where there are no rows
    (0 for counts and sums, say); others are null there.

    The buckets are calculated from the intervals, per combination, and meet
    the aggregated rows, so no input row is read or moved for it.
    """
    if granularity.lower() == "none":
        raise ValueError("single instants cannot be filled")
    found = time_bucket_agg(df, ts, granularity, aggs=aggs, intervals=intervals, where=where, dims=dims, out=out)
    groups = found.select(*dims).distinct() if dims else df.sparkSession.range(1).select()
    spine = groups.select(
        *[F.col(d).alias(f"_dim{i}") for i, d in enumerate(dims)], F.explode(bucket_series(df, ts, granularity, intervals)).alias("_bucket")
    )
    met = F.col("_bucket") == F.col(out)
    for i, d in enumerate(dims):
        met = met & F.col(f"_dim{i}").eqNullSafe(F.col(d))
    joined = spine.join(found.withColumn("_found", F.lit(True)), met, "left")
    values = [
        F.when(F.col("_found"), F.col(name)).otherwise(F.lit((empty or {}).get(name)).cast(found.schema[name].dataType)).alias(name)
        for name in aggs
    ]
    return joined.select(F.col("_bucket").alias(out), *[F.col(f"_dim{i}").alias(d) for i, d in enumerate(dims)], *values)


def top_n_per_bucket(
    df: DataFrame,
    ts: str,
    granularity: str,
    dim: str,
    metric: Column,
    k: int,
    *,
    intervals: Sequence[tuple[Any, Any]] | None = None,
    where: Mapping[str, Any] | Column | None = None,
    metric_name: str = "metric",
    out: str = "bucket",
) -> DataFrame:
    """The ``k`` largest values of ``dim`` by ``metric`` in every bucket, with their rank.

    Equal metrics rank by the dimension's value.  The rows are aggregated
    first, and each task keeps only its own k best per bucket before the
    shuffle.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    totals = time_bucket_agg(
        df, ts, granularity, aggs={metric_name: metric}, intervals=intervals, where=where, dims=[dim], out=out
    )
    best = Window.partitionBy(out).orderBy(F.desc_nulls_last(metric_name), F.asc_nulls_first(dim))
    return totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
