"""The place of every row in its key's order, without a task that holds a key.

Ordered windows and arrays need to know where a row stands in its key.  Keys
that fit a task are numbered by an ordinary window.  Where one key does not,
the rows of *all* keys are laid out in ranges of their full order (key, order,
ties), like the pages of a sorted file:

* equal rows are first combined to one row with a number of copies, so that a
  value that fills half a table is one row;
* the cuts between ranges are quantiles of a sample, found and used inside
  Spark; any column that can be sorted is cut, texts and structs included;
* each range is numbered on its own, and what a key has in earlier ranges is
  added: a prefix sum over the ranges' counts.

The numbers are the same either way, so whether a key was cut shows nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 5_000_000

AT = "_at"
COPIES = "_copies"
_RANGE = "_range"
#: rows of the sample for each range; the largest of many ranges then holds about twice the mean
_SAMPLED = 16
#: more ranges are not made: one task sorts the sample, and the carried counts, a row for each range but the first, are broadcast
_MAX_RANGES = 10_000


def largest_key(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows in all, and in the largest key.  Counts are combined on the map side; one row reaches the driver."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    row = sizes.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most")).first()
    return row["rows"] or 0, row["most"] or 0


def same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equal column by column, a null being equal to a null."""
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(left, right)])


def _cuts(rows: DataFrame, place: Column, total: int, ranges: int) -> DataFrame:
    """One row: the ascending places at which a range begins.

    The sample is drawn by a hash of the place, so it is the same wherever and
    however often it is drawn, and holds a place once however many rows share it.
    """
    every = max(1, total // (ranges * _SAMPLED))
    sampled = rows.select(place.alias("p")).where(F.pmod(F.xxhash64(F.lit("sample"), "p"), F.lit(every)) == 0)
    sorted_ = sampled.agg(F.array_sort(F.collect_set("p")).alias("s"))
    last = F.size("s") - 1
    wanted = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.floor(i.cast("bigint") * F.size("s") / ranges).cast("int"))
    return sorted_.select(F.transform(wanted, lambda i: F.get("s", F.least(i, last))).alias("cuts"))


def _range_number(cuts: Column, place: Column, ranges: int) -> list[Column]:
    """The number of cuts at or below the place, by binary search, as a chain of expressions for one column each."""
    steps = [2**i for i in reversed(range(max(ranges - 1, 1).bit_length()))]

    def next_(step: int, first: bool) -> Column:
        span = F.lit(0) if first else F.col(_RANGE)
        above = F.get(cuts, span + (step - 1)) <= place
        return span + F.coalesce(above, F.lit(False)).cast("int") * step

    return [next_(step, i == 0) for i, step in enumerate(steps)]


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    large_keys: str | None = "auto",
    rows_per_task: int = ROWS_PER_TASK,
) -> tuple[DataFrame, bool]:
    """Add the 0-based place of each row in its key, and tell whether keys were cut.

    ``df`` has the columns ``keys`` and ``order`` only, so that rows tied in
    the order are equal; nulls come first, and null keys are keys.  If keys
    were cut, equal rows are one row: ``_at`` is the place of its first copy
    and ``_copies`` their number (1 in all rows otherwise).

    ``large_keys="auto"`` counts the rows per key first and cuts if one has
    more than ``rows_per_task``; None never does.  The ranges hold about that
    many rows, or more where this would make over 10,000 of them.
    """
    keys, order = list(keys), list(dict.fromkeys(order))
    if large_keys not in ("auto", None):
        raise ValueError(f"large_keys must be 'auto' or None, not {large_keys!r}")
    if rows_per_task < 1:
        raise ValueError("rows_per_task must be at least 1")
    by = [F.asc_nulls_first(c) for c in order if c not in keys]
    total, most = largest_key(df, keys) if large_keys == "auto" else (0, 0)
    if most <= rows_per_task:
        frame = Window.partitionBy(*keys).orderBy(*by)
        place = F.row_number().over(frame).cast("bigint") - 1
        return df.withColumns({AT: place, COPIES: F.lit(1).cast("bigint")}), False

    ranges = min(math.ceil(total / rows_per_task), _MAX_RANGES)
    place = F.struct(*keys, *[c for c in order if c not in keys])
    cuts = _cuts(df, place, total, ranges).scalar()

    def ranged(rows: DataFrame) -> DataFrame:
        for number in _range_number(cuts, place, ranges):
            rows = rows.withColumn(_RANGE, number)
        return rows

    # what a key has in earlier ranges; only the first key of a range can have any, so there is a row a range at most
    counts = ranged(df).groupBy(*keys, _RANGE).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy(_RANGE)) - F.col("_n")
    carried = counts.select(
        *[F.col(k).alias(f"_c_{i}") for i, k in enumerate(keys)], F.col(_RANGE).alias("_c_range"), earlier.alias("_carried")
    ).where("_carried > 0")

    runs = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))
    inside = Window.partitionBy(*keys, _RANGE).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged(runs).withColumn("_inside", F.sum(COPIES).over(inside) - F.col(COPIES))
    met = same([F.col(k) for k in keys], [F.col(f"_c_{i}") for i in range(len(keys))]) & (F.col(_RANGE) == F.col("_c_range"))
    at = F.col("_inside") + F.coalesce("_carried", F.lit(0))
    return numbered.join(F.broadcast(carried), met, "left").select(*df.columns, at.alias(AT), COPIES), True


def split_runs(rows: DataFrame, keys: Sequence[str], size: int, reach: int = 0, *, out: str = "_part") -> DataFrame:
    """Deal runs of copies to the parts ``place div size`` of their keys that they touch, cut at the parts' ends.

    With ``reach`` a part also gets the rows of that many places before it.
    """
    end = F.col(AT) + F.col(COPIES)
    first, last = F.floor(F.col(AT) / size), F.floor((end - 1 + reach) / size)
    dealt = rows.withColumn(out, F.explode(F.sequence(first, last)))
    start = F.greatest(F.col(AT), F.col(out) * size - reach)
    return dealt.withColumns({AT: start, COPIES: F.least(end, (F.col(out) + 1) * size) - start})
