"""Group-by with named accumulators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from arealis.operators.positions import AT, COPIES, ROWS_PER_TASK, number_rows, split_runs

MAX_ARRAY = 100_000


@dataclass(frozen=True)
class Push:
    """Rows of a group as ordered arrays; see :func:`push`."""

    fields: tuple[str, ...]
    order: tuple[str, ...]
    scalar: bool
    distinct: bool = False
    max_array: int = MAX_ARRAY


Accumulator = Column | Push


def total(column: Column | str) -> Column:
    """Sum; the sum of nothing is 0."""
    return F.coalesce(F.sum(column), F.lit(0))


def mean(column: Column | str) -> Column:
    return F.avg(column)


def least(column: Column | str) -> Column:
    return F.min(column)


def greatest(column: Column | str) -> Column:
    return F.max(column)


def std_pop(column: Column | str) -> Column:
    return F.stddev_pop(column)


def std_samp(column: Column | str) -> Column:
    return F.stddev_samp(column)


def rows() -> Column:
    """Number of rows, nulls included."""
    return F.count(F.lit(1))


def first(column: str, order: Sequence[str]) -> Column:
    """Value in the first row by ``order``; an order is required."""
    return F.min_by(column, F.struct(*_ordered(order)))


def last(column: str, order: Sequence[str]) -> Column:
    """Value in the last row by ``order``; an order is required."""
    return F.max_by(column, F.struct(*_ordered(order)))


def push(fields: str | Sequence[str], order: Sequence[str], *, max_array: int = MAX_ARRAY) -> Push:
    """Array of a field's values, or of structs for several fields, in ``order``.

    A single field's nulls are missing values and are left out.
    """
    scalar = isinstance(fields, str)
    return Push((fields,) if scalar else tuple(fields), tuple(_ordered(order)), scalar, False, max_array)


def add_to_set(column: str, *, max_array: int = MAX_ARRAY) -> Push:
    """Sorted array of a column's distinct values."""
    return Push((column,), (column,), True, True, max_array)


def _ordered(order: Sequence[str]) -> list[str]:
    names = [order] if isinstance(order, str) else list(order)
    if not names:
        raise ValueError("an explicit order is required")
    return names


def collect_parts(
    rows: DataFrame, by: Sequence[str], element: Column, out: str, *, max_array: int, cut: bool, carry: str | None = None
) -> DataFrame:
    """Arrays of the elements at places ``part * max_array`` on: by, part, array.

    ``rows`` has places and copies as of :func:`number_rows`; null elements
    are left out.  Where the place comes from a window over the same columns,
    the grouping needs no further shuffle.  ``carry`` is a column that is
    constant in a group and is kept.
    """
    if max_array < 1:
        raise ValueError("max_array must be at least 1")
    kept = [carry] if carry else []
    if cut:
        rows = split_runs(rows, by, max_array, out="part")
    else:
        rows = rows.withColumn("part", F.floor(F.col(AT) / max_array))
    row = F.when(element.isNotNull(), F.struct(F.col(AT), F.col(COPIES), element.alias("_e")))
    arrays = (
        rows.select(*by, F.col("part").cast("bigint").alias("part"), *kept, row.alias("_row"))
        .groupBy(*by, "part")
        .agg(F.array_sort(F.collect_list("_row")).alias("_rows"), *[F.min(c).alias(c) for c in kept])
    )
    if cut:
        whole = F.flatten(F.transform("_rows", lambda r: F.array_repeat(r["_e"], r[COPIES].cast("int"))))
    else:
        whole = F.transform("_rows", lambda r: r["_e"])
    return arrays.select(*by, "part", *kept, whole.alias(out))


def push_parts(
    df: DataFrame,
    by: Sequence[str],
    spec: Push,
    out: str,
    *,
    large_keys: str | None = "auto",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The arrays of one :func:`push` or :func:`add_to_set`: by, part, array.

    Element i of a group is in part ``i div max_array``; a group too large for
    one task is numbered in ranges of its order, with the same result.
    """
    by = list(by)
    names = list(dict.fromkeys([*by, *spec.order, *spec.fields]))
    needed = df.select(*names)
    if spec.scalar:
        needed = needed.where(F.col(spec.fields[0]).isNotNull())
    if spec.distinct:
        needed = needed.distinct()
    # fields follow the order columns, so that only equal elements are tied
    placed, cut = number_rows(needed, by, names, large_keys=large_keys, rows_per_task=rows_per_task)
    element = F.col(spec.fields[0]) if spec.scalar else F.struct(*spec.fields)
    return collect_parts(placed, by, element, out, max_array=spec.max_array, cut=cut)


def group(
    df: DataFrame,
    by: str | Sequence[str],
    accumulators: Mapping[str, Accumulator],
    *,
    large_keys: str | None = "auto",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Group by ``by`` (nulls form a group) and compute the named accumulators.

    Column accumulators are combined on the map side.  With a :func:`push` or
    :func:`add_to_set` the result also has a ``part`` column: element i of a
    group's array is in part ``i div max_array``, in every array alike, and
    the column accumulators, which belong to the group, stand in each part.
    Groups with more than ``rows_per_task`` rows are numbered in ranges (see
    :func:`number_rows`), which changes no row of the result.
    """
    by = [by] if isinstance(by, str) else list(by)
    scalars = {name: spec for name, spec in accumulators.items() if not isinstance(spec, Push)}
    pushes = {name: spec for name, spec in accumulators.items() if isinstance(spec, Push)}
    if not pushes:
        return df.groupBy(*by).agg(*[spec.alias(name) for name, spec in scalars.items()])

    # a row for each part that a group can have, so that a group's parts never meet in one task
    base = df.groupBy(*by).agg(*[spec.alias(name) for name, spec in scalars.items()], _most_parts(pushes.values()).alias("_parts"))
    joined = _each_part(base, by)
    for name, spec in pushes.items():
        parts = push_parts(df, by, spec, name, large_keys=large_keys, rows_per_task=rows_per_task)
        joined = _join_null_safe(joined, parts, [*by, "part"])
    # a set has fewer elements than its group has rows, so not every part is there
    joined = joined.where(reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in pushes], F.col("part") == 0))
    filled = [
        F.coalesce(name, F.array().cast(joined.schema[name].dataType)).alias(name)
        if name in pushes
        else F.col(name)
        for name in accumulators
    ]
    return joined.select(*by, "part", *filled)


def _most_parts(pushes: Iterable[Push]) -> Column:
    """Parts that hold a group's elements, at least 1; copies, which a set leaves out, count too."""

    def parts(spec: Push) -> Column:
        elements = F.count(F.col(spec.fields[0]) if spec.scalar else F.lit(1))
        return F.floor((elements - 1) / spec.max_array) + 1

    return reduce(lambda a, b: F.greatest(a, b), map(parts, pushes), F.lit(1).cast("bigint"))


def _each_part(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each part of a group below ``_parts``; in two steps, as a sequence is held whole."""
    step, last = 10_000, F.col("_parts") - 1
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / step))))
    first = F.col("_block") * step
    part = F.explode(F.sequence(first, F.least(first + (step - 1), last)))
    return blocks.select(*by, part.alias("part"), *[c for c in groups.columns if c not in (*by, "_parts")])


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which null keys match each other, with one copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in on])
    joined = left.join(renamed, condition, "left")
    return joined.select(*[left[c] for c in left.columns], *[renamed[c] for c in right.columns if c not in on])


def count_rows(df: DataFrame, out: str = "count") -> DataFrame:
    """The number of rows, as one row."""
    return df.agg(F.count(F.lit(1)).alias(out))


def sort_by_count(df: DataFrame, column: str) -> DataFrame:
    """Values of a column with their number of rows, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first(column))


def sortable_columns(df: DataFrame) -> list[str]:
    """Columns of a plain type, usable as an order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType) and f.dataType.typeName() != "variant"]
