"""Moving averages over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from arealis.operators.grouping import collect_parts
from arealis.operators.positions import AT, COPIES, ROWS_PER_TASK, largest_key, number_rows, split_runs

MAX_ARRAY = 100_000


def _series(df: DataFrame, key: str, date: str, feature: str, ties: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns of the series and an order that leaves only equal rows tied."""
    if "_value" in (key, date, *ties):
        raise ValueError("a column of the series cannot be named _value")
    numeric = isinstance(df.schema[feature].dataType, NumericType)
    value = F.col(feature).cast("double") if numeric else F.col(feature).try_cast("double")
    names = list(dict.fromkeys([key, date, *ties]))
    rows = df.where(F.col(key).isNotNull()).select(*names, value.alias("_value"))
    return rows, [*(c for c in names if c != key), "_value"]


def _full_windows(
    df: DataFrame,
    key: str,
    date: str,
    feature: str,
    days: int,
    ties: Sequence[str],
    large_keys: str | None,
    rows_per_task: int,
) -> tuple[DataFrame, bool]:
    """Every full window: key, date of the last row, its place ``_at`` among the windows, average; and whether keys were cut.

    The rows of a key are dealt to blocks of places, each with the last
    ``days`` - 1 rows before it, so that all its windows lie inside.
    """
    rows, order = _series(df, key, date, feature, ties)
    out = [key, date, (F.col(AT) - (days - 1)).alias(AT), COPIES, "_mean"]
    placed, cut = number_rows(rows, [key], order, large_keys=large_keys, rows_per_task=rows_per_task)
    if not cut:
        frame = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in order])
        mean = F.avg("_value").over(frame.rowsBetween(-(days - 1), 0))
        return placed.withColumn("_mean", mean).where(F.col(AT) >= days - 1).select(*out), False
    size = max(rows_per_task, days)
    dealt = split_runs(placed, [key], size, days - 1, out="_block")
    # copies become rows only where their block is, so no task makes more than a block of them
    spread = dealt.repartition(key, "_block").withColumn(AT, F.explode(F.sequence(F.col(AT), F.col(AT) + F.col(COPIES) - 1)))
    frame = Window.partitionBy(key, "_block").orderBy(AT)
    mean = F.avg("_value").over(frame.rowsBetween(-(days - 1), 0))
    windows = spread.withColumns({"_mean": mean, COPIES: F.lit(1).cast("bigint")})
    return windows.where((F.col(AT) >= days - 1) & (F.col(AT) >= F.col("_block") * size)).select(*out), True


def moving_average(
    df: DataFrame,
    key: str,
    date: str,
    feature: str,
    days: int,
    *,
    tie_breakers: Sequence[str] = (),
    large_keys: str | None = "auto",
    rows_per_task: int = ROWS_PER_TASK,
    out: str = "avg",
) -> DataFrame:
    """Average of the last ``days`` rows of each key, ordered by ``date``.

    The window counts rows, not calendar days, and only full windows give a
    row: a key with n rows has n - days + 1 of them, dated by their last row.
    Null values keep their place and do not count in the average.

    ``large_keys="auto"`` counts the rows per key first; if one has more than
    ``rows_per_task``, all keys are computed in ranges of the full order (key,
    date, ties, value), whatever the types.  Pass None where the series are
    known to be short (one row per key and day, say); the plan is then one
    shuffle on the key.  The result is the same.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    windows, _ = _full_windows(df, key, date, feature, days, tie_breakers, large_keys, rows_per_task)
    return windows.select(key, date, F.col("_mean").alias(out))


def moving_average_docs(
    df: DataFrame,
    key: str,
    date: str,
    feature: str,
    days: int,
    *,
    tie_breakers: Sequence[str] = (),
    large_keys: str | None = "auto",
    rows_per_task: int = ROWS_PER_TASK,
    max_array: int = MAX_ARRAY,
) -> DataFrame:
    """The moving averages of a key as a document.

    Columns: key, part, ``numDays``, ``startDate`` (first date of the series,
    before windowing) and ``movingAverages``, an array of (date, avg).  A key
    with fewer than ``days`` rows has an empty array.  Window i of a series is
    in part ``i div max_array``, so arrays stay bounded and nothing is left
    out; keys too large for one task give the same documents.
    """
    if days < 1:
        raise ValueError("days must be at least 1")
    rows, order = _series(df, key, date, feature, tie_breakers)
    element = F.struct(F.col(date).alias("date"), F.col("_mean").alias("avg"))
    if large_keys != "auto" or largest_key(rows, [key])[1] <= rows_per_task:
        # one pass: the rows before the first full window add nothing to the
        # array but keep their key, and the start date comes from the same sort
        frame = Window.partitionBy(key).orderBy(*[F.asc_nulls_first(c) for c in order])
        whole = rows.withColumns(
            {
                "_mean": F.avg("_value").over(frame.rowsBetween(-(days - 1), 0)),
                "_place": F.row_number().over(frame),
                "startDate": F.min(date).over(Window.partitionBy(key)),
                COPIES: F.lit(1).cast("bigint"),
            }
        )
        placed = whole.withColumn(AT, F.greatest(F.col("_place") - days, F.lit(0)))
        element = F.when(F.col("_place") >= days, element)
        documents = collect_parts(
            placed, [key], element, "movingAverages", max_array=max_array, cut=False, carry="startDate"
        )
        return documents.select(key, "part", F.lit(days).alias("numDays"), "startDate", "movingAverages")

    windows, _ = _full_windows(df, key, date, feature, days, tie_breakers, "auto", rows_per_task)
    parts = collect_parts(windows, [key], element, "movingAverages", max_array=max_array, cut=False)
    starts = rows.groupBy(key).agg(F.min(date).alias("startDate"))
    kind = parts.schema["movingAverages"].dataType
    return starts.join(parts, key, "left").select(
        key,
        F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
        F.lit(days).alias("numDays"),
        "startDate",
        F.coalesce("movingAverages", F.array().cast(kind)).alias("movingAverages"),
    )
